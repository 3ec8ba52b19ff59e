"""One query for each operator, over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import bpe, chat, hosts, language, lines, nearest, neardup, negatives, packing, private, quality, tokencount, variants
from tidelens.llm.common import crc32_of_id, table
from tidelens.sources.folders import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


#: Labelled documents of either label that the line fields are fitted on.
SAMPLE_EACH = 400
#: Documents that score lower are predicted to have label 0.
LEAST_QUALITY = 0.3


def content_field(spark: SparkSession, documents: DataFrame, sf_dir: str) -> lines.Crf:
    return quality.learn_content(*lines.labelled_sample(documents, table(spark, sf_dir, "labels"), SAMPLE_EACH))


def quality_classifier(spark: SparkSession, documents: DataFrame, sf_dir: str) -> quality.Classifier:
    """Learned from labels of documents whose crc32 of the id, modulo 5, is not 0."""
    labels = table(spark, sf_dir, "labels").filter(crc32_of_id() % 5 != 0)
    return quality.learn(*lines.labelled_sample(documents, labels, SAMPLE_EACH))


def op1_content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.keep_content(documents, content_field(spark, documents, sf_dir))


def op2_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_boosted_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = private.find(documents, private.learn(documents))
    counts = [F.size(F.filter("base", of)).cast("long").alias(f"n_{k}") for k, of in private.IS_KIND.items()]
    return found.select("doc_id", *counts, F.sha2(private.listed(F.col("base")), 256).alias("base_sha256"), private.listed(F.col("spans")).alias("spans"))


#: By host and path.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


# Public suffixes of two labels that hosts are registered under.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of its id; bound is what the method judges a page by that no rule fits."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return hosts.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, suffixes=SUFFIXES).select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


def op5_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = nearest.whole_parts(table(spark, sf_dir, "embeddings"))
    return nearest.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents, language.profiles(documents, crc32_of_id() % 3 != 1))
    return found.select("doc_id", (crc32_of_id() % 3 == 1).alias("held_out"), "lang_pred", "score")


def op8_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = quality.score(documents, quality_classifier(spark, documents, sf_dir))
    return found.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= LEAST_QUALITY).cast("int").alias("predicted"))


def op7_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.expand(turns), arranged=True)


def op10_bitmap_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every text that is there is counted in this run."""
    import public_tokenizers

    cache = tokencount.Cache(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op12_automaton_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_voronoi_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    vectors = negatives.labelled(rows)
    return negatives.hard_negatives(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def queries() -> dict[str, Query]:
    return {
        "op1_content_lines": op1_content_lines,
        "op2_chosen_path_near_duplicates": op2_chosen_path_near_duplicates,
        "op3_host_reputation": op3_host_reputation,
        "op4_boosted_private_spans": op4_boosted_private_spans,
        "op5_kd_tree_top_k": op5_kd_tree_top_k,
        "op6_hyperdimensional_language": op6_hyperdimensional_language,
        "op8_line_field_quality": op8_line_field_quality,
        "op7_power_of_two_packing": op7_power_of_two_packing,
        "op9_prefix_target_chat": op9_prefix_target_chat,
        "op10_bitmap_queue_bpe": op10_bitmap_queue_bpe,
        "op11_digest_cache_counts": op11_digest_cache_counts,
        "op12_automaton_variants": op12_automaton_variants,
        "op13_voronoi_hard_negatives": op13_voronoi_hard_negatives,
    }


_RULE_CASES = " ".join(
    f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{{{rule}}}'"
    for rule in sorted(URL_RULES, key=len, reverse=True)
    for host, path in [(rule.split("/", 1)[0], "/" + rule.split("/", 1)[1])]
)


def _shrunk_level(own: str, children: str, mean: str) -> str:
    """The strength of a level's prior, as a subquery over its children."""
    return f"""(select case when w > 0 then 1 / least(1 / 3.0, greatest(0.001, (s - v) / w)) - 1 else 999.0 end from (select
        sum(n * (bad / n - {mean}) * (bad / n - {mean})) as s, sum({mean} * (1 - {mean})) as v, sum({mean} * (1 - {mean}) * (n - 1)) as w
        from {children} where n > 0) as {own})"""


def _labels_sql(n: int) -> str:
    """The last n labels of a host, one more if its suffix has two; a bare address whole."""
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"case when regexp_full_match(host, '[0-9.]+') then host when {last(2)} in ({two}) then {last(n + 1)} else {last(n)} end"


_OP3_SQL = f"""
with base as (
    select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
known as (select doc_id as page_id, max(1 - quality) as bad from labels where doc_id is not null and quality in (0, 1) group by doc_id),
hosts as (
    select host, {_labels_sql(2)} as domain, {_labels_sql(1)} as suffix,
        cast(count(bad) as double) as n, cast(coalesce(sum(bad), 0) as double) as bad
    from base left join known using (page_id) group by host),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
tops as (select suffix, sum(n) as n, sum(bad) as bad, (select sum(bad) / nullif(sum(n), 0) from hosts) as up from domains group by suffix),
top_means as (select suffix, (bad + m * up) / (n + m) as up from tops, (select {_shrunk_level("a", "tops", "up")} as m) as x),
domains_up as (select domain, n, bad, up from domains join top_means using (suffix)),
domain_means as (select domain, (bad + m * up) / (n + m) as up from domains_up, (select {_shrunk_level("b", "domains_up", "up")} as m) as x),
hosts_up as (select host, n, bad, up from hosts join domain_means using (domain)),
found as (
    select host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + m + 1)) as bound
    from (select host, n, m, (bad + m * up) / (n + m) as mean from hosts_up, (select {_shrunk_level("c", "hosts_up", "up")} as m) as x) as y),
judged as (select page_id, host, path, case {_RULE_CASES.replace("{", "").replace("}", "")} end as rule, bound from base join found using (host))
select page_id, host, path, rule, case rule {" ".join(f"when '{r}' then '{v}'" for r, v in URL_RULES.items())} else case when bound > 0.5 then 'block' else 'allow' end end as verdict, round(bound, 6) as bound
from judged
"""

_OP5_SQL = """
with whole as (
    select row_number() over () as nth, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.nth, q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
    from whole q join whole c on q.nth <> c.nth and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by nth order by score desc, vec_id) as rank from scored) as r where rank <= 5
"""


_OP13_SQL = """
with whole as (
    select row_number() over () as nth, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.nth, q.vec_id as anchor_id, c.vec_id as vec_id, q.label = c.label as same, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
    from whole q join whole c on q.nth <> c.nth and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
liked as (
    select * from (select *, row_number() over (partition by nth order by score desc, vec_id) as place from scored where same) as r where place <= 5),
hard as (
    select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
        row_number() over (partition by p.nth, p.place order by n.score desc, n.vec_id) as rank
    from liked p join scored n on p.nth = n.nth and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from hard where rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_host_reputation": _OP3_SQL, "op5_kd_tree_top_k": _OP5_SQL, "op13_voronoi_hard_negatives": _OP13_SQL}
