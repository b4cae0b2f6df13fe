"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablestore.llm import bpe, mixing, neardup, neighbours, quality, rules, scoring, sharding, substring, urls

#: Host, path, verdict of the url rules.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


#: The tokenizer file, by the name that the public_tokenizers package knows; any path can take its place.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def url_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as rows, without Python on the executors."""
    return spark.sql(f"select * from values {', '.join(map(str, URL_RULES))} as rules(host, path, verdict)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), scoring.in_training(F.col("doc_id")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), url_rules(spark))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(tokenizer_path()).read_text(encoding="utf-8")
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.score(docs, quality.train(docs, labels))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # more batches than runs may stay, so that history is joined, compacted and joined again
    return substring.dedupe(table(spark, sf_dir, "documents"), batches=4, max_runs=2).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *rules.METRICS, "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_bpe": op5_bpe,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op3_url_filters": f"""
with listed(host, path, verdict) as (values {", ".join(map(str, URL_RULES))}),
rests as (select page_id, case when url is not null and strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
hits as (select p.page_id, l.host || l.path as rule, l.verdict,
    row_number() over (partition by p.page_id order by length(l.host || l.path) desc, length(l.host) desc) as n
    from parts p join listed l on (p.host = l.host or ends_with(p.host, '.' || l.host)) and starts_with(p.path, l.path))
select p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') as verdict
from parts p left join hits h on p.page_id = h.page_id and h.n = 1""",
    "op7_substring_dedup": f"""
with texts as (select doc_id, {WORDS} as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from texts where len(w) >= 35) t),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by win) as n from windows) t where n > 1),
gone as (select distinct doc_id, i + k as i from twice cross join (select unnest(range(0, 35)) as k) ks),
placed as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from texts),
kept as (select p.doc_id, count(*) as n, string_agg(p.word, ' ' order by p.i) as body from placed p left join gone g on p.doc_id = g.doc_id and p.i = g.i where g.i is null group by p.doc_id)
select t.doc_id, cast(len(t.w) as bigint) as n_words, cast(len(t.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.body, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id""",
    "op9_quality_rules": f"""
with texts as (select doc_id, source, coalesce(text, '') as t, {WORDS} as w from documents),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from texts where len(w) >= 3) x),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) x where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice cross join (select unnest(range(0, 3)) as k) ks group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from texts),
dups as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
metrics as (select a.doc_id, a.source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(d.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
    from texts a left join dups d on a.doc_id = d.doc_id left join covered c on a.doc_id = c.doc_id),
judged as (select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
    100 * n_symbols > {rules.MAX_SYMBOL_PERCENT} * word_chars or n_dup_lines > {rules.MAX_DUP_LINES} or 100 * n_repeat_words > {rules.MAX_SOME_REPEAT_PERCENT} * n_words as some_failed from metrics),
hosts as (select source, count(*) as n, sum(case when base_failed or some_failed then 1 else 0 end) as failed from judged where source is not null group by source),
prior as (select m, case when v > 0 then least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) else 1000.0 end as k from (select avg(failed / n) as m, var_pop(failed / n) as v from hosts) x),
verdicts as (select source, (failed + m * k) / (n + k) as rate, m from hosts cross join prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce(rate <= {rules.MAX_HOST_RATE} and not (rate > {rules.SUSPECT} * m and some_failed), true) as kept
from judged j left join verdicts v on j.source = v.source""",
    "op10_mixing": f"""
with sized as (select doc_id, source, cast(len({WORDS}) as bigint) as size,
    md5(case when doc_id is null then '{mixing.SEED}||' || md5(coalesce(text, '')) else '{mixing.SEED}|' || doc_id end) as key from documents),
sources as (select source, sum(size) as s, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from sized group by source),
ranked as (select *, sum({mixing.MAX_EPOCHS} * s) over by_ratio - {mixing.MAX_EPOCHS} * s as capped, sum(w) over () - sum(w) over by_ratio + w as open, sum(s) over () as total
    from sources window by_ratio as (order by {mixing.MAX_EPOCHS} * s / w, source nulls last rows unbounded preceding)),
level as (select arg_min(per, ratio) as per from (select (total - capped) / open as per, {mixing.MAX_EPOCHS} * s / w as ratio from ranked) x where per <= ratio),
budget as (select source, cast(s as bigint) as source_size, case when per * w > {mixing.MAX_EPOCHS} * s then {mixing.MAX_EPOCHS} * s else per * w end as target from ranked cross join level),
placed as (select d.doc_id, d.size, b.source_size, b.target, cast(floor(b.target) as bigint) as words,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and 1 preceding), 0) as before
    from sized d join budget b on d.source is not distinct from b.source),
cut as (select *, case when source_size = 0 then 0 else least({mixing.MAX_EPOCHS}, words // source_size) end as epochs from placed)
select doc_id, size, source_size, cast(target as double) as target,
    cast(epochs * size + case when epochs < {mixing.MAX_EPOCHS} then greatest(0, least(size, words - epochs * source_size - before)) else 0 end as bigint) as taken from cut""",
}
