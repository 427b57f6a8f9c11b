"""Operator 4 beyond its index space: hashed places that collide."""

from pitspark.llm import training_order


def test_equal_places(spark, monkeypatch):
    monkeypatch.setattr(training_order, "_WIDEST", 8)  # far ids hashed to 8 places: most sequences share one
    rows = [(i * 10**15, f"text {i} " * (i % 300)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = training_order.ordered_sequences(df).collect()
    pieces = {(r.doc_id, r.piece) for r in got}
    assert len(pieces) == len(got) and {d for d, _ in pieces} == {i for i, _ in rows}
    assert sorted(r.slot for r in got) == list(range(len(got)))
    again = training_order.ordered_sequences(df.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
