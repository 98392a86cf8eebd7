"""The relational fold, the Python book and a naive book agree; streams give what batches give."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.operators import orders, runs
from tapeloom.operators.book import Book
from tapeloom.sources.tables import corpus
from tapeloom.sources.wire import trace_hash


def naive(messages):
    live, out = {}, []
    for m in messages:
        kind, ref = m["type"], m["order_ref"]
        if kind == "A":
            e = "zero_ref" if ref == 0 else "bad_qty" if m["shares"] <= 0 else "duplicate_ref" if ref in live else "none"
            if e == "none":
                live[ref] = m["shares"]
        elif kind in "ECX":
            e = "bad_qty" if m["shares"] <= 0 else "unknown_order" if ref not in live else "over_execute" if m["shares"] > live[ref] else "none"
            if e == "none":
                live[ref] -= m["shares"]
        else:
            e = "none" if ref in live else "unknown_order"
            live.pop(ref, None)
        live = {k: v for k, v in live.items() if v}
        out.append(e)
    return out, live


message = st.fixed_dictionaries({"type": st.sampled_from("AAECXD"), "order_ref": st.integers(0, 4), "shares": st.integers(0, 6), "price": st.integers(10, 13), "side": st.sampled_from("BS")})


@given(st.lists(message, max_size=60))
@settings(max_examples=200, deadline=None)
def test_book_is_the_naive_book(messages):
    book = Book()
    errors, sums = [], {}
    for m in messages:
        errors.append(book.apply(m))
        for side, price, change in book.deltas:
            sums[side, price] = sums.get((side, price), 0) + change
        assert book.sound()
    want, live = naive(messages)
    assert errors == want
    assert {r: o[2] for r, o in book.orders.items()} == live
    assert {k: v for k, v in sums.items() if v} == {(s, p): q for s, p, q in book.l2()}


def test_relational_fold_is_the_naive_book(spark):
    rnd = random.Random(3)
    rows = [(i, i, 1, rnd.choice("AAECXD"), rnd.randint(0, 12), rnd.randint(0, 6), rnd.randint(10, 13), rnd.choice("BS")) for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, ts_ns long, locate long, type string, order_ref long, shares long, price long, side string").repartition(5)
    want, live = naive([dict(zip(("seq", "ts", "locate", "type", "order_ref", "shares", "price", "side"), r, strict=True)) for r in rows])
    effect = orders.effects(df).orderBy("seq").collect()
    assert [r.status.replace("ok", "none") for r in effect] == want
    assert {r.order_ref: r.qty for r in orders.resting(orders.effects(df)).collect()} == live


def test_replace_and_queries():
    b = Book(0, 100)
    assert [b.add(1, "B", 5, 50), b.add(2, "B", 7, 50), b.add(3, "S", 4, 60), b.add(9, "S", 1, 100)] == ["none", "none", "none", "out_of_band"]
    assert (b.best("B"), b.best("S"), b.front("B", 50), b.ahead(2), b.ahead(9)) == (50, 60, 1, 5, -1)
    assert b.replace(1, 4, 5, 50) == "none" and b.queue("B", 50) == [(2, 7), (4, 5)] and b.side_of(4) == "B" and b.side_of(1) == "?"
    assert [b.replace(1, 5, 1, 50), b.replace(2, 4, 1, 50), b.replace(2, 6, 0, 50), b.replace(2, 6, 1, 200)] == ["unknown_order", "duplicate_ref", "bad_qty", "out_of_band"]
    assert b.add(7, "B", 1, 40) == "none" and (b.below("B", 50), b.above("B", 40), b.above("B", 50)) == (40, 50, None)


def test_generated_messages_hash():
    rows = corpus(42, 96)
    assert trace_hash(rows) == 0x308E35B105CFE9D0
    assert [sum(m["type"] == t for m in rows) for t in "AFECXDU"] == [14, 14, 14, 14, 14, 13, 13]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_is_batch(spark, tmp_path, parts):
    rnd = random.Random(parts)
    rows = [(i, i % 3, rnd.choice("AAAECXDU"), rnd.randint(1, 9), rnd.randint(10, 14), rnd.randint(1, 5), rnd.randint(10, 13), rnd.choice("BS")) for i in range(200)]
    schema = "seq long, locate long, type string, order_ref long, new_ref long, shares long, price long, side string"
    from tapeloom.streaming.book import book_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(parts):
        spark.createDataFrame(rows[k * 200 // parts : (k + 1) * 200 // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = book_stream(stream).writeStream.format("memory").queryName(f"book{parts}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = sorted(map(tuple, runs.book_fold(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(map(tuple, spark.table(f"book{parts}").collect())) == want
