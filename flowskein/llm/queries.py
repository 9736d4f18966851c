"""Queries of the training-data operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowskein.llm import mixing, packing, quality, sketches
from flowskein.session import table


def _summaries(spark: SparkSession, sf_dir: str, groups: list[str]) -> DataFrame:
    return sketches.summaries(sketches.tool_measures(table(spark, sf_dir, "tool_calls")), groups, "value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that the tools' percentiles exceed."""
    over = sketches.over_limit(_summaries(spark, sf_dir, ["tool", "measure"]), table(spark, sf_dir, "tool_limits"))
    return over.select("tool", "measure", "pct")


PCTS = [50.0, 90.0, 99.0]


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per tool and measure with the rank error reached."""
    return sketches.percentiles(_summaries(spark, sf_dir, ["tool", "measure"]), ["tool", "measure"], PCTS)


def p4_daily_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per tool and measure, combined from summaries of single days."""
    days = _summaries(spark, sf_dir, ["day", "tool", "measure"])
    # a day's summary uses half of the permitted error, the combination the rest
    return sketches.percentiles(sketches.merged(days, ["tool", "measure"], 2 * sketches.ERROR), ["tool", "measure"], PCTS)


def p4_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles, of the whole and combined from days, have ranks within their stated errors."""
    values = sketches.tool_measures(table(spark, sf_dir, "tool_calls"))
    keys = ["tool", "measure"]
    parts = [sketches.rank_check(values, found(spark, sf_dir), keys).withColumn("made_of", F.lit(how)) for how, found in (("partitions", p4_percentiles), ("days", p4_daily_combined))]
    return parts[0].unionByName(parts[1])


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.windows(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are larger than a window, as the packing had to cut them."""
    return _windows(spark, sf_dir).filter("n_pieces > 1 AND piece = 0").select("doc_id")


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window and place of every piece of every document."""
    return _windows(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows used and the share of their room that is filled."""
    return packing.fill_report(_windows(spark, sf_dir))


def _shares(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Share]]:
    documents = table(spark, sf_dir, "documents")
    return documents, mixing.shares(documents, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose repeats cannot bring them to their share of the mixture."""
    documents, plan = _shares(spark, sf_dir)
    return mixing.share_report(mixing.mixture(documents, plan), plan).filter("is_short").select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mixture with its block."""
    return mixing.mixture(*_shares(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    documents, plan = _shares(spark, sf_dir)
    return mixing.share_report(mixing.mixture(documents, plan), plan)


def p8_share_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mixture gives each source what its target and cap allow, by the mixture's own rows."""
    documents, plan = _shares(spark, sf_dir)
    return mixing.share_bounds(mixing.mixture(documents, plan), documents, plan)


def p7_guarantees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows must keep: capacity, every token once, no cut without need, hardly any room left."""
    return packing.guarantees(_windows(spark, sf_dir), table(spark, sf_dir, "documents"))


def p9_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest structural profile, prose share and divergences of every document."""
    documents = table(spark, sf_dir, "documents")
    profiles = quality.fit_profiles(documents, table(spark, sf_dir, "doc_labels"))
    return quality.profile_documents(documents, profiles)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of whose text more than half is no natural prose."""
    return p9_profiles(spark, sf_dir).filter("prose_share < 0.5").select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic text counts of every document, with the common words and ends of lines of all languages of the corpus."""
    return quality.basic_statistics(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p4_found, p4_percentiles, p4_daily_combined, p4_rank_check, p7_found, p7_windows, p7_fill, p7_guarantees, p8_found, p8_mixture, p8_shares,
        p8_share_bounds,
        p9_found, p9_profiles, p9_statistics,
    )
}

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
ORACLES = {
    "p4_found": f"""
WITH c AS (SELECT DISTINCT id, lower(trim(tool, {_BLANK})) AS tool, duration_ms, result_bytes FROM tool_calls),
m AS (SELECT tool, 'duration_ms' AS measure, duration_ms AS value FROM c UNION ALL SELECT tool, 'result_bytes', result_bytes FROM c),
v AS (SELECT tool, measure, value, row_number() OVER (PARTITION BY tool, measure ORDER BY value) AS rn, count(*) OVER (PARTITION BY tool, measure) AS n FROM m WHERE value >= 0)
SELECT l.tool, l.measure, l.pct FROM tool_limits l JOIN v ON v.tool = l.tool AND v.measure = l.measure AND v.rn = greatest(1, CAST(ceil(l.pct * v.n / 100.0) AS BIGINT)) WHERE v.value > l.limit_value""",
    "p4_rank_check": f"""
WITH c AS (SELECT DISTINCT id, lower(trim(tool, {_BLANK})) AS tool, duration_ms, result_bytes FROM tool_calls),
m AS (SELECT tool, 'duration_ms' AS measure, duration_ms AS value FROM c UNION ALL SELECT tool, 'result_bytes', result_bytes FROM c)
SELECT tool, measure, p AS pct, count(*) AS n_exact, true AS within, h AS made_of
FROM m, (VALUES (50.0::DOUBLE), (90.0), (99.0)) AS a(p), (VALUES ('partitions'), ('days')) AS b(h) WHERE value >= 0 AND tool IS NOT NULL GROUP BY tool, measure, p, h""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
    "p8_found": f"""
WITH d AS (SELECT lower(trim(source, {_BLANK})) AS source, strlen(coalesce(text, '')) AS n FROM documents WHERE trim(source, {_BLANK}) <> ''),
t AS (SELECT sum(n) AS total FROM d), s AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
SELECT m.source FROM mix_targets m CROSS JOIN t LEFT JOIN s ON s.source = m.source WHERE coalesce(s.n, 0) * m.max_repeats < m.target_share * t.total""",
    "p8_share_bounds": f"""
WITH s AS (SELECT lower(trim(source, {_BLANK})) AS source, sum(strlen(coalesce(text, ''))) AS n FROM documents WHERE trim(source, {_BLANK}) <> '' GROUP BY 1)
SELECT m.source, m.max_repeats, CAST(coalesce(s.n, 0) AS BIGINT) AS available_tokens, true AS reaches, true AS within, true AS capped FROM mix_targets m LEFT JOIN s ON s.source = m.source""",
    "p7_guarantees": """
SELECT count(*) AS n_documents, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_tokens, count(*) FILTER (strlen(text) > 4096) AS n_cut, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_overlaps,
  CAST(0 AS BIGINT) AS n_wrong_sizes, true AS tight FROM documents""",
    "p9_statistics": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]', ' ', 'g')) <> '') AS l FROM d),
b AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')) AS b FROM s)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
  coalesce(round(length(array_to_string(w, '')) / nullif(len(w), 0), 6), 0.0) AS mean_word_chars,
  coalesce(round(length(regexp_replace(t, '[\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]', '', 'g')) / nullif(length(t), 0), 6), 0.0) AS symbol_share,
  coalesce(round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;,。！？：；，、．][ \\t\\n\\x0B\\f\\r]*$'))) / nullif(len(l), 0), 6), 0.0) AS ended_line_share,
  round(greatest(%s, CASE WHEN regexp_matches(t, '[ぁ-ゞ]') THEN length(regexp_replace(t, '[^%s]', '', 'g')) / nullif(length(regexp_replace(t, '[^\\p{L}]', '', 'g')), 0) ELSE 0 END), 6) AS common_word_share
FROM b"""
    % (
        ", ".join(
            "coalesce(len(list_filter(b, lambda x: list_contains([{0}], x) OR list_contains([{0}], replace(regexp_extract(x, '^[^\\x27’]+[\\x27’]'), '’', chr(39))))) / nullif(len(b), 0), 0)".format(
                ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words.split()))
            )
            for words in quality.FUNCTION_WORDS.values()
        ),
        quality._KANA,
    ),
}
