import numpy as np
import pytest

from flowskein.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_windows_hold_what_fits(seed):
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.integers(0, 4097, 400), rng.integers(0, 300, 600), np.array([0, 4096, 4096, 1])])
    window = packing.pack(sizes, 4096)
    used = np.bincount(window, weights=sizes)
    assert (window >= 0).all() and used.max() <= 4096
    assert len(used) <= 1.02 * np.ceil(sizes.sum() / 4096) + 2


def test_configurations_beat_greedy_on_thirds():
    sizes = np.array([1366] * 30 + [1365] * 60)  # 1366 + 2 * 1365 fills a window
    assert packing.pack(sizes, 4096).max() + 1 == 30


def test_every_document_has_its_place(spark):
    docs = [(1, "a" * 9000, 0), (2, "é" * 100, 0), (3, "", 0), (4, None, 0), (None, "x", 0), (None, "x", 0), (5, "b" * 4096, 0), (5, "b" * 4096, 0)]
    rows = packing.windows(spark.createDataFrame(docs, "doc_id bigint, text string, piece int")).collect()
    pieces = sorted((r["piece"], r["n_tokens"]) for r in rows if r["doc_id"] == 1)
    assert pieces == [(0, 4096), (1, 4096), (2, 808)] and all(r["n_pieces"] == 3 for r in rows if r["doc_id"] == 1)
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 2] == [200]
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 5 for r in rows) == 2
    spans = sorted((r["window_id"], r["start"], r["start"] + r["n_tokens"]) for r in rows if r["n_tokens"])
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:])) and max(s[2] for s in spans) <= 4096
    assert packing.windows(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_repeated_rows_are_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 100)
    monkeypatch.setattr(packing, "CELL_ITEMS", 500)
    rows = [(1, "x" * 700)] * 3_000 + [(i, "y" * 50) for i in range(2, 1_000)] + [(None, "z")] * 250
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = packing.windows(documents)
    assert placed.count() == len(rows) and placed.filter("doc_id = 1").count() == 3_000 and placed.filter("doc_id IS NULL").count() == 250
    cells = [r["count"] for r in placed.filter("doc_id = 1").groupBy(packing.F.shiftrightunsigned("window_id", 32)).count().collect()]
    assert len(cells) > 4 and max(cells) < 1_000
    kept = packing.guarantees(placed, documents).first()
    assert kept["n_overfull"] == kept["n_overlaps"] == kept["n_wrong_sizes"] == 0 and kept["n_documents"] == len(rows)
