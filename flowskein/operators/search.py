"""Lexical, vector and hybrid search over entity tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.predicates import is_test_file, test_rank_penalty
from flowskein.functions.scalars import content_hash, cosine, dot, is_exact, norm, rounded_score, search_tokens
from flowskein.operators.evidence import per_type_top

K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60


def postings(docs: DataFrame) -> DataFrame:
    """Inverted index of ``doc_id``, ``text``: ``doc_id``, ``token``, ``tf``, ``len``."""
    tokens = docs.select("doc_id", search_tokens(F.col("text")).alias("__t"))
    return tokens.select("doc_id", F.size("__t").alias("len"), F.explode("__t").alias("token")).groupBy("doc_id", "token", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], prefix: bool = True) -> DataFrame:
    """BM25 of every document that holds a query term (or a word it begins): ``doc_id``, ``score``.

    Terms score apart and add up. Only matching tokens are kept, and all the
    corpus contributes to counts and mean length, in one pass over the texts.
    """
    terms = F.array(*(F.lit(q) for q in query))
    tokens = docs.select("doc_id", search_tokens(F.coalesce("text", F.lit(""))).alias("__t"))
    hit = (lambda t, q: t.startswith(q)) if prefix else (lambda t, q: t == q)
    counted = tokens.select("doc_id", F.size("__t").alias("len"), F.transform(terms, lambda q: F.struct(q.alias("q"), F.size(F.filter("__t", lambda t: hit(t, q))).alias("tf"))).alias("m"))
    stats = counted.select("len", *(F.expr(f"int(m[{i}].tf > 0)").alias(f"h{i}") for i in range(len(query)))).agg(
        F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.sum(f"h{i}").alias(f"n{i}") for i in range(len(query)))
    ).first()
    if not stats["n"]:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    score: Column = F.lit(0.0)
    for i in range(len(query)):
        n_i = stats[f"n{i}"] or 0
        idf = F.greatest(F.ln((F.lit(float(stats["n"])) - n_i + 0.5) / (F.lit(float(n_i)) + 0.5)), F.lit(LEAST_IDF))
        tf = F.expr(f"m[{i}].tf")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(stats["avg"])))).otherwise(0.0)
    return counted.filter(F.exists("m", lambda x: x["tf"] > 0)).select("doc_id", score.alias("score"))


def top_per_type(scored: DataFrame, types: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each type: ``doc_id``, ``type``, ``score``, ``rank``; ties by id."""
    return per_type_top(scored.join(types, "doc_id"), "type", [F.col("score").desc(), F.col("doc_id")], k)


def cosine_top(vectors: DataFrame, query: list[float], k: int, by: str = "type") -> DataFrame:
    """Brute-force cosine against one vector; the best ``k`` of each type."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return per_type_top(vectors.withColumn("score", F.round(cosine(F.col("vector"), q), 9)).drop("vector"), by, [F.col("score").desc(), F.col("doc_id")], k)


def cosine_top_each(vectors: DataFrame, queries: DataFrame, k: int, by: str = "type") -> DataFrame:
    """Brute-force cosine of all vectors against each of ``queries`` (``query_id``, ``query``); the best ``k`` of each query and type.

    Neither side goes to the driver. Every block of queries meets every block of
    rows, and a block keeps its best before the shuffle.
    """
    v, q = vectors.withColumn("__n", norm(F.col("vector"))), queries.withColumn("__m", norm(F.col("query")))
    both = F.col("__n") * F.col("__m")
    score = F.round(F.when(both == 0, 0.0).otherwise(dot(F.col("vector"), F.col("query")) / both), 9)
    scored = v.crossJoin(q).withColumn("score", score).drop("vector", "query", "__n", "__m")
    return per_type_top(scored, ["query_id", by], [F.col("score").desc(), F.col("doc_id")], k)


def rrf(lexical: DataFrame, semantic: DataFrame, exact: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two rankings (``doc_id``, ``rank``): score, and which arms hit.

    ``exact`` (``doc_id``) marks exact hits, which come first whatever their score.
    With ``by`` (of both rankings) each of its values is fused apart.
    """
    a = lexical.select(*by, "doc_id", F.col("rank").alias("__l"))
    b = semantic.select(*by, "doc_id", F.col("rank").alias("__s"))
    both = a.join(b, [*by, "doc_id"], "full")
    both = both.join(exact.select("doc_id", F.lit(True).alias("__x")), "doc_id", "left") if exact is not None else both.withColumn("__x", F.lit(False))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    label = F.when(F.col("__x"), "exact").when(F.col("__l").isNotNull() & F.col("__s").isNotNull(), "fused").when(F.col("__l").isNotNull(), "lexical").otherwise("semantic")
    return both.select(*by, "doc_id", (part("__l") + part("__s")).alias("score"), label.alias("match"))


def capped(fused: DataFrame, types: DataFrame, caps: dict[str, int], most: int) -> DataFrame:
    """Hits in order (exact, score, id), at most ``caps[type]`` (else ``most``) of each type."""
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("type")), F.lit(most)) if caps else F.lit(most)
    order = W.partitionBy("type").orderBy((F.col("match") == "exact").desc(), F.col("score").desc(), "doc_id")
    return fused.join(types, "doc_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def _begins(word: str) -> Callable[[Column], Column]:
    return lambda t: t.startswith(word)


def search_nodes(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes whose label, file or service holds a word that a query word begins.

    Exact labels first, then production files, then the number of query words
    met, then id.
    """
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w]
    text = search_tokens(F.concat_ws(" ", "label", "file", "service"))
    found = nodes.withColumn("__t", text)
    met: Column = F.lit(0)
    for w in words:
        met = met + F.when(F.exists("__t", _begins(w)), 1).otherwise(0)
    scored = found.withColumn("n_words", met).filter("n_words > 0").withColumn("exact", is_exact(F.col("label"), F.lit(query)).cast("int"))
    scored = scored.withColumn("penalty", test_rank_penalty(F.col("file")))
    return scored.orderBy(F.col("exact").desc(), "penalty", F.col("n_words").desc(), "id").limit(limit).select("id", "label", "type", "service", "file", "exact", "penalty", "n_words")


def resolve_target(nodes: DataFrame, query: str, service: str = "", node_type: str = "") -> DataFrame:
    """Candidates of a target: the id itself, else labels equal whatever the case, else the best search hit.

    Narrowed by service and type where given; production files before tests,
    then service, file, id; ``pick`` 1 is the target.
    """
    def narrow(df: DataFrame) -> DataFrame:
        df = df.filter(F.col("service") == service) if service else df
        return df.filter(F.col("type") == node_type) if node_type else df

    cols = ("id", "label", "type", "service", "file")
    literal = nodes.filter(F.col("id") == query).select(*cols)
    if literal.limit(1).count():
        return literal.withColumn("pick", F.lit(1))
    exact = narrow(nodes.filter(F.lower("label") == query.lower())).select(*cols)
    hits = exact if exact.limit(1).count() else narrow(search_nodes(nodes, query)).select(*cols)
    order = W.partitionBy(F.lit(1)).orderBy(is_test_file(F.col("file")), "service", "file", "id")
    return hits.orderBy(is_test_file(F.col("file")), "service", "file", "id").limit(20).withColumn("pick", F.row_number().over(order))


def roots_per_service(candidates: DataFrame) -> DataFrame:
    """One root for each service: the first candidate there."""
    return candidates.withColumn("__r", F.row_number().over(W.partitionBy("service").orderBy("pick"))).filter("__r = 1").drop("__r")


def resolution_note(query: str, exact: bool) -> str:
    return "" if exact else f"no exact match for {query!r}: the nearest name is used"


def expand_query(query: str, synonyms: dict[str, list[str]]) -> str:
    """Query with the synonyms of its words after it."""
    extra = [s for w in query.lower().split() for s in synonyms.get(w, [])]
    return " ".join([query, *extra])


def expanded(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """As ``expand_query``, for a column of queries."""
    known = F.create_map(*(x for w, more in synonyms.items() for x in (F.lit(w), F.array(*(F.lit(m) for m in more)))))
    extra = F.flatten(F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.coalesce(F.try_element_at(known, w), F.expr("cast(array() as array<string>)"))))
    return F.concat_ws(" ", query, extra)


def enriched(ids: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids of a result (``entity_id``) with their entities' texts and, for nodes, their columns; what is unknown stays with nulls."""
    n = nodes.select(F.col("id").alias("entity_id"), "label", F.col("type").alias("node_type"), "service", "file", "line")
    return ids.join(entities.select("entity_id", "text"), "entity_id", "left").join(n, "entity_id", "left")


def stale_embeddings(entities: DataFrame, stored: DataFrame, embedder: str) -> DataFrame:
    """Entities (``entity_id``, ``text``) to embed again: new text, or another embedder."""
    wanted = entities.withColumn("content_hash", content_hash(F.col("text"))).withColumn("embedder", F.lit(embedder))
    return wanted.join(stored.select("entity_id", "content_hash", "embedder"), ["entity_id", "content_hash", "embedder"], "left_anti")


def embedder_conflict(stored: DataFrame) -> DataFrame:
    """More than one embedder behind the stored vectors is an error."""
    return stored.agg(F.countDistinct("embedder").alias("n_embedders")).withColumn("consistent", F.col("n_embedders") <= 1)


def embedded(entities: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors by a pluggable function of a batch of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"entity_id": frame["entity_id"], "vector": embed(frame["text"].fillna("").tolist())})

    return entities.select("entity_id", "text").mapInPandas(run, "entity_id string, vector array<float>")


def hashed_features(text: Column, dims: int = 64) -> Column:
    """Stand-in embedding inside the JVM: word counts by hash bucket, of unit length."""
    buckets = F.transform(search_tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def rank_margin(scored: DataFrame, by: list[str]) -> DataFrame:
    """Score of rank 1 less that of rank 2, 0 without a second."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id")
    first = scored.withColumn("__r", F.row_number().over(order)).withColumn("__next", F.lead("score").over(order)).filter("__r = 1")
    return first.select(*by, "doc_id", rounded_score(F.coalesce(F.col("score") - F.col("__next"), F.lit(0.0))).alias("margin"))


def chunks(docs: DataFrame, most: int = 800) -> DataFrame:
    """Markdown sections at headings, cut further after ``most`` characters: ``doc_id``, ``chunk_no``, ``heading``, ``text``.

    Whole texts, inside the JVM: a heading is a line that begins with 1 to 6 ``#``.
    """
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?m)^(?=#{1,6} )"), lambda p: F.trim(p) != "")
    sections = docs.select("doc_id", F.posexplode(parts).alias("s", "section"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("section") / most).cast("int") - 1, F.lit(0)))
    cut = sections.select("doc_id", "s", "section", F.explode(pieces).alias("p"))
    return cut.select(
        "doc_id", F.col("s").alias("section_no"), F.col("p").alias("piece_no"), F.regexp_extract("section", r"^#{1,6} (.*)", 1).alias("heading"),
        F.substr("section", F.col("p") * most + 1, F.lit(most)).alias("text"),
    )
