"""Quality rules on documents and their hosts, in DataFrame functions only.

A document fails the base rules by its own words (too few, or too much repetition), and further rules by symbols, repeated
lines or a fair amount of repetition. Failures of any rule are counted by host, and each host's failure rate is shrunk
towards the mean of all hosts with a beta prior fitted to the hosts by moments. The host's verdict decides over
documents that pass the base rules: a host above the prior's mean is suspect, and its documents must pass all rules;
a host whose shrunken rate is far too high falls with all its documents; other hosts' documents stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestore.llm.common import SPACES, checkpoint, fresh, quoted, scratch, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Further rules: symbols for each hundred signs of words, repeated lines, and repeated words in percent.
MAX_SYMBOL_PERCENT, MAX_DUP_LINES, MAX_SOME_REPEAT_PERCENT = 2, 2, 30
#: A host falls if its shrunken failure rate exceeds this, and is suspect above so many times the prior's mean.
MAX_HOST_RATE = 0.8
SUSPECT = 1.01
#: Verdicts of at most this many fallen or suspect hosts are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 50_000

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add METRICS and base_failed to every row; columns of those names are replaced.

    Null and empty texts have no words and fail. Texts are read whole. Each row is judged alone, so
    repeated rows get equal results. 3-word windows are compared by a 64-bit hash within one text.
    """
    w, grams, ordered, twice = fresh("w"), fresh("g"), fresh("o"), fresh("t")
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    dup_lines = F.size(lines) - F.size(F.array_distinct(lines))
    df = docs.withColumns({
        w: words(F.col(text)),
        "word_chars": F.length(F.translate(whole, SPACES, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": dup_lines.cast("long"),
    })
    df = df.withColumns({"n_words": F.size(w).cast("long"), grams: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))})
    whole_grams = F.slice(F.col(grams), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    placed = F.transform(whole_grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct(whole_grams)) < F.size(whole_grams)
    df = df.withColumn(ordered, F.when(repeats, F.sort_array(placed)))
    df = df.withColumn(twice, F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"])))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long"))
    # size() of null is -1 or null by configuration; a text without repeats has none
    df = df.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long")))
    return df.withColumn("base_failed", fails("n_words", "n_repeat_words")).drop(w, grams, ordered, twice)


def fails(n_words: str, n_repeat: str) -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEAT_PERCENT * F.col(n_words))


def fails_some() -> Column:
    """Whether a document fails one of the further rules, which only documents of suspect hosts must pass."""
    return ((100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (F.col("n_dup_lines") > MAX_DUP_LINES)
            | (100 * F.col("n_repeat_words") > MAX_SOME_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, suspect: float = SUSPECT) -> DataFrame:
    """One row for each non-null host: n, failed, rate (shrunken), mean (the prior's), verdict (ok, suspect, bad).

    `judged` has the host, base_failed and some_failed. The prior is Beta(m * k, (1 - m) * k): m is the mean of the hosts'
    rates and k follows from their variance v by moments, m * (1 - m) / v - 1, held within 1 and 1000. Without
    spread (one host, or equal rates) k is 1000, every host keeps the common rate, and none is suspect.
    """
    failed = (F.col("base_failed") | F.col("some_failed")).cast("long")
    hosts = checkpoint(judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed")))
    raw = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()
    m = m or 0.0
    k = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
    shrunk = (F.col("failed") + m * k) / (F.col("n") + k)
    verdict = F.when(shrunk > max_rate, "bad").when(shrunk > suspect * m, "suspect").otherwise("ok")
    return hosts.select("host", "n", "failed", shrunk.alias("rate"), F.lit(m).alias("mean"), verdict.alias("verdict"))


def with_verdicts(judged: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Add `kept` to rows that have base_failed, some_failed and the host. The rows are read twice.

    A null host has no verdict: the base rules decide alone. Only fallen and suspect hosts take part in the join; they are
    broadcast if their number is within BROADCAST_HOSTS, and otherwise joined by shuffle, where Spark splits hot hosts.
    """
    verdicts = checkpoint(host_verdicts(judged, host, max_rate).where("verdict != 'ok'"), BROADCAST_HOSTS)
    key, flag = fresh("host"), fresh("verdict")
    bad = verdicts.select(F.col("host").alias(key), F.col("verdict").alias(flag))
    if verdicts.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = judged.join(bad, judged[host] == F.col(key), "left")
    falls = (F.col(flag) == "bad") | F.col("some_failed")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col(flag).isNull() | ~falls)).drop(key, flag)


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each document: id, host, METRICS, base_failed, some_failed, kept. Texts pass no shuffle.

    Null, empty and wordless texts fail the base rules; repeated rows count as often as they occur and get equal
    verdicts; an empty table gives no rows.
    """
    metrics = with_metrics(docs.select(id, text, host), text).select(id, host, *METRICS, "base_failed", fails_some().alias("some_failed"))
    return with_verdicts(checkpoint(metrics), host, max_rate)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of `docs` that pass, with exactly their columns. Texts are judged once and pass no shuffle.

    Null, empty and wordless texts go; repeated rows stay or go together; an empty table gives no rows. The judged
    rows, without those that fail the base rules, wait in a scratch folder for the hosts' verdicts.
    """
    row, text_copy, host_copy = fresh("row"), fresh("text"), fresh("host")
    whole = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias(row), quoted(text).alias(text_copy), quoted(host).alias(host_copy))
    judged = with_metrics(whole, text_copy).withColumn("some_failed", fails_some())
    judged = judged.select(F.when(~F.col("base_failed"), F.col(row)).alias(row), host_copy, "base_failed", "some_failed")
    return with_verdicts(scratch(judged), host_copy, max_rate).where("kept").select(f"{row}.*")
