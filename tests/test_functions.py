import pytest
from pyspark.sql import functions as F

from flowskein.functions import normalize as N
from flowskein.functions import predicates as P
from flowskein.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "names, before, after",
    [
        (["param_wildcard"], "/x/:id", "/x/*"), (["param_wildcard"], "/x/{id}", "/x/*"), (["param_wildcard"], "/u/%d/e", "/u/*/e"), (["param_wildcard"], "/a/${t}-c/b", "/a/*/b"),
        (["param_wildcard"], "/a/[slug]?/b", "/a/*/b"), (["trim_slash"], "", ""), (["trim_slash"], "/", "/"), (["trim_slash"], "/a//", "/a"), (["trim_slash"], "//", "/"),
        (["url_to_path", "query_strip"], "http://h/p?q", "/p"), (["url_to_path"], "http://h", "/"), (["url_to_path"], "/p", "/p"), (["dynamic_host_strip"], "*/api/x", "/api/x"),
        (["empty_path_guard"], "*", ""), (["empty_path_guard"], "/*/*/", ""), (["empty_path_guard"], "/", "/"), (["empty_path_guard"], "", ""), (["shared_anchor_guard"], "/*/a", "/*/a"),
        (["quote_strip"], "'a'", "a"), (["quote_strip"], '"', '"'), (["quote_strip"], "`a'", "`a'"), (["case_fold"], "GET", "get"), (["amqp_topic_wildcard"], "a.#.b.*", "a.*.b.*"), (["amqp_topic_wildcard"], "#", "*"),
    ],
)
def test_normalizers(spark, names, before, after):
    assert one(spark, N.normalize_fields([F.col("k")], names), k=before) == after


def test_unknown_normalizer_is_refused():
    with pytest.raises(ValueError, match="unknown normalizer"):
        N.normalize_fields([F.lit("x")], ["nope"])


def test_base_url(spark):
    strip = lambda k, b: one(spark, N.base_url_strip(F.col("k"), N.Env(F.col("b"))), k=k, b=b)
    assert [strip("/api/x", "/api"), strip("/api", "/api"), strip("/x", "/api"), strip("/x", "")] == ["/x", "/", "/x", "/x"]


@pytest.mark.parametrize(
    "key, pattern, match",
    [("/api/v1/*/*/d", "/api/v1/admin/users/*", False), ("/api/v1/users/9", "/api/v1/users/*", True), ("/a/*", "/a/b", True), ("/api/*", "/api/b", False), ("/a/b", "/a", False), ("/*/b", "/a/b", True)],
)
def test_segments(spark, key, pattern, match):
    assert one(spark, N.segments_match(N.segments(F.col("k")), N.segments(F.col("p"))), k=key, p=pattern) is match


def test_predicates(spark):
    tests = ["a/x_test.go", "x.spec.ts", "test_a.py", "spec/a.rb", "a/__tests__/b.js", "a/spec/b"]
    assert all(one(spark, P.is_test_file(F.col("f")), f=f) for f in tests) and not one(spark, P.is_test_file(F.col("f")), f="src/attest.go")
    assert one(spark, P.test_rank_penalty(F.col("f")), f="tests/a.go") == 1 and not one(spark, P.is_test_file(F.col("f")), f="tests/a.go")
    assert [one(spark, P.path_evidence(F.col("p")), p=p) for p in ("/*", "http:/*", "/a/*", "/a", "/a/b/*")] == ["none", "none", "weak", "strong", "strong"]
    assert P.noise_included([], "generate") == ["render_tree"] and P.noise_included(["all"]) and P.noise_included(["none"]) == []
    with pytest.raises(ValueError):
        P.noise_included(["x"])
    with pytest.raises(ValueError):
        P.passes_verification(F.lit("x"), "maybe")
    noise = P.noise_class(F.col("t"), F.col("v"), F.col("d"))
    assert [one(spark, noise, t=t, v=v, d=d) for t, v, d in (("calls", "rails_filter", ""), ("inherits", "", ""), ("imports", "", ""), ("renders", "", "element"), ("calls", "", ""))] == ["filter_chain", "mixin", "containment", "render_tree", ""]


def test_scalars(spark):
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, S.l2_normalized(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert [one(spark, S.age_text(F.lit(s))) for s in (0, -5, 59, 3600, 90_000)] == ["", "", "0m", "1h", "1d"]
    assert one(spark, S.sql_table(F.lit("SELECT a FROM Orders o; DELETE FROM x"))) == "orders" and one(spark, S.sql_table(F.lit("vacuum"))) == ""
    assert [one(spark, S.json_tag_name(F.lit(t))) for t in ('json:"id,omitempty"', 'json:"-"', "xml")] == ["id", "", ""]
    assert one(spark, S.env_var_name(F.lit('os.Getenv("ORDERS_URL")'))) == "ORDERS_URL" and one(spark, S.service_hint(F.lit("ORDERS_SERVICE_URL"))) == "orders"
    assert one(spark, S.slug(F.lit(" A b/C! "))) == "a-b-c" and one(spark, S.normal_fact(F.lit("`A`  'b'"))) == "a b"
    assert [one(spark, S.failure_class(F.lit(m))) for m in ("", "rate limit", "timeout", "boom")] == ["", "quota", "transient", "fatal"]
    assert one(spark, S.is_exact(F.lit("Sink "), F.lit("find sink"))) and one(spark, S.snippet(F.lit("a\nb\nc"), F.lit(2), 2)) == "b\nc"
    assert one(spark, S.channel_label(F.lit("ex"), F.lit("rk"), F.lit("l"), F.lit("get"), F.lit("/p"))) == "ex rk" and one(spark, S.channel_label(F.lit(""), F.lit(None), F.lit(""), F.lit("get"), F.lit("/p"))) == "get /p"


SOURCE = "array<struct<provider string, confidence string, ref string, observed_at bigint, code_file string, code_func string>>"


@pytest.mark.parametrize(
    "providers, confidence, state",
    [
        (["static", "runtime"], "partial", "verified"), (["static", "config"], "static", "verified"), (["static", "contract"], "static", "verified"), (["static", "contract"], "partial", "candidate"),
        (["static"], "static", "candidate"), (["runtime"], "", "observed_only_gap"), (["contract"], "", "observed_only_gap"), (["llm"], "", "candidate"), ([], None, "candidate"),
    ],
)
def test_state_machine(spark, providers, confidence, state):
    rows = [([(p, "", "r", 1, "f" if p == "runtime" else "", "") for p in providers], confidence)]
    df = spark.createDataFrame(rows, f"sources {SOURCE}, confidence string").withColumn("s", S.verification_state(F.col("sources"), F.col("confidence")))
    row = df.select("s", S.verified_granularity(F.col("s"), F.col("sources")).alias("g"), S.is_stale(F.col("s"), F.col("sources"), F.lit(10**8)).alias("old")).first()
    assert row["s"] == state and row["g"] == ("" if state != "verified" else "site" if "runtime" in providers else "channel")
    assert row["old"] is (state == "verified" and "runtime" in providers)


def test_sources_merge(spark):
    rows = [([("b", "", "r", 2, "", ""), ("a", "", "r", 5, "", ""), ("a", "", "r", 3, "x", "")],)]
    merged = spark.createDataFrame(rows, f"sources {SOURCE}").select(S.merged_sources(F.col("sources")).alias("m")).first()["m"]
    assert [(m["provider"], m["observed_at"]) for m in merged] == [("a", 3), ("b", 2)]
