import pytest
from edge_cases import edge_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=3), st.integers(1, 60), min_size=1, max_size=8))
def test_every_prefix_is_within_one_block(shares):
    period, had = sum(shares.values()), dict.fromkeys(shares, 0)
    table = mixing.edf_period(shares)
    assert [slot for _, _, slot in table] == list(range(period))
    for source, i, slot in table:
        assert i == had[source]
        had[source] += 1
        for s, n in had.items():
            assert abs(n - shares[s] * (slot + 1) / period) < 1
    assert had == shares


def test_documents_follow_the_target_until_a_source_runs_out(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else "small")) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    shares, block = {"big": 2, "mid": 2, "small": 1}, 4
    got = sorted(mixing.mix_order(docs, shares, block=block).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(6000))
    assert sorted(r.doc_id for r in got) == list(range(6000))
    had = dict.fromkeys(shares, 0)
    for n, r in enumerate(got, 1):
        had[r.source] += 1
        if n <= 2000:
            for s, k in had.items():
                assert abs(k - n * shares[s] / 5) < 2 * block  # a block in progress and one block of lag
    assert had == {"big": 4000, "mid": 1000, "small": 1000}


def test_sources_without_a_share_come_last(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "doc_id long, source string")
    got = sorted(mixing.mix_order(docs, {"a": 1}).collect(), key=lambda r: r.position)
    assert [r.source for r in got] == ["a"] * 50 + ["b"] * 50


def test_edges(spark):
    docs = edge_docs(spark)
    got = mixing.mix_order(docs).collect()
    key = lambda r: (r.doc_id, r.source)
    assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, docs.collect())))
    assert sorted(r.position for r in got) == list(range(docs.count()))
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, docs.collect()))
    order = [key(r) for r in sorted(got, key=lambda r: r.position)]
    assert [key(r) for r in rows.collect()] == order
    assert mixing.mix_order(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


def brute(rows, shares, block):
    """Source of each position: blocks by earliest deadline among the released, slot by slot."""
    left = {s: sum(1 for _, x in rows if x == s) for s in shares}
    period, out, n = sum(shares.values()), [], dict.fromkeys(shares, 0)
    slot = 0
    while any(left.values()):
        released = [s for s in shares if n[s] * period // shares[s] <= slot]
        s = min(released, key=lambda s: (-(-(n[s] + 1) * period // shares[s]), s))
        n[s] += 1
        out += [s] * min(block, left[s])
        left[s] -= min(block, left[s])
        slot += 1
    return out


def test_equals_brute_force_with_a_third_without_id(spark):
    rows = [(None if i % 3 == 0 else i % 1000, ["big", "big", "mid", "small"][i % 4]) for i in range(3000)]
    docs = spark.createDataFrame([(*r, f"text {i % 700}") for i, r in enumerate(rows)], "doc_id long, source string, text string").repartition(5)
    shares = {"big": 5, "mid": 3, "small": 1}
    got = sorted(mixing.mix_order(docs, shares, block=16).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(3000))
    assert [r.source for r in got] == brute(rows, shares, 16)
    mixed = mixing.mixed(docs, shares).collect()
    assert [r.source for r in mixed] == [r.source for r in got]
    assert sorted(map(repr, mixed)) == sorted(map(repr, docs.collect()))
    longest = run = 0
    for a, b in zip(got[:1200], got[1:1200]):
        run = run + 1 if (a.source, a.doc_id) == (b.source, b.doc_id) else 0
        longest = max(longest, run)
    assert longest < 16


def test_rows_without_id_spread_over_partitions(spark):
    docs = spark.createDataFrame([(None, "a", f"t{i}") for i in range(4000)], "doc_id long, source string, text string")
    keyed = mixing._keyed(docs, "doc_id", "source")
    sizes = keyed.repartitionByRange(8, "source", "mixed", "doc_id", "row").groupBy(mixing.F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000


def test_many_sources_keep_shares_of_their_own():
    counts = {f"s{i}": 1 + i for i in range(5000)}
    shares = mixing.tempered_shares(counts)
    assert len(set(shares.values())) > 20 and shares["s4999"] > 5 * shares["s99"]


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    docs = spark.createDataFrame([(i, str(i)) for i in range(5)], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mix_order(docs)
