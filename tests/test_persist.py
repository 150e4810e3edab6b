"""Saved analyses: repeated, broken-off and late batches."""

import pytest

from vitrina.operators.persist import APPENDED, REPLACED, Store, columns_of

JAN, FEB, MAR = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"


def part(spark, ids, word):
    analysis = spark.createDataFrame([(i, "COMPLETED", len(word)) for i in ids], "business_id long, status string, opportunity_score int")
    evidence = spark.createDataFrame([(i, f"{word}-{k}") for i in [*ids, 999] for k in range(2)], "business_id long, code string")
    contact = spark.createDataFrame([(i, "EMAIL", f"{word}{i}@x.es") for i in ids if i % 5], "business_id long, type string, value string")
    return analysis, {"evidence": evidence, "contact": contact, "snapshot": analysis}


def shown(store):
    return {t: sorted(map(str, store.read(t).select(*sorted(c for c in store.read(t).columns)).collect())) for t in [*APPENDED, *REPLACED]}


def save(store, spark, batch, at, ids, word):
    analysis, more = part(spark, ids, word)
    store.save(batch, at, analysis, **more)


def test_repeats_and_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=3)
    assert all(not rows for rows in shown(store).values())
    save(store, spark, "b1", JAN, range(1, 12), "one")
    save(store, spark, "b2", FEB, range(6, 20), "two")
    first = shown(store)
    assert len(first["analysis"]) == 25 and len(first["evidence"]) == 50 and len(first["snapshot"]) == 19
    values = {r["value"] for r in store.read("contact").collect()}
    assert values == {f"one{i}@x.es" for i in range(1, 5)} | {f"two{i}@x.es" for i in range(6, 20) if i % 5}
    for batch, at, ids, word in (("b2", FEB, range(6, 20), "two"), ("b1", JAN, range(1, 12), "one")):
        save(store, spark, batch, at, ids, word)
        assert shown(store) == first
    assert {r["business_id"]: r["batch"] for r in store.latest().collect()} == {i: "b1" if i < 6 else "b2" for i in range(1, 20)}
    assert [r["batch"] for r in store.history(1).where("business_id = 7").collect()] == ["b2"] and store.history(5).where("business_id = 7").count() == 2


def test_a_broken_off_batch_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    save(store, spark, "b1", JAN, range(1, 9), "one")
    before = shown(store)

    def fail(self, table, *rest):
        if table == "snapshot":
            raise RuntimeError("lost")
        return replace(self, table, *rest)

    replace = Store._replace
    with monkeypatch.context() as m:
        m.setattr(Store, "_replace", fail)
        with pytest.raises(RuntimeError):
            save(store, spark, "b2", FEB, range(4, 9), "two")
    assert shown(store) == before
    save(store, spark, "b3", MAR, range(8, 10), "three")
    assert {r["value"] for r in store.read("contact").collect()} == {f"one{i}@x.es" for i in (1, 2, 3, 4, 6, 7)} | {"three8@x.es", "three9@x.es"}
    save(store, spark, "b2", FEB, range(4, 9), "two")
    assert {r["value"] for r in store.read("contact").where("business_id between 4 and 8").collect()} == {"two4@x.es", "two6@x.es", "two7@x.es", "three8@x.es"}


def test_an_analysis_without_contacts_clears_them(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    save(store, spark, "b1", JAN, [1, 2], "one")
    store.save("b2", FEB, part(spark, [1], "two")[0])
    assert [r["value"] for r in store.read("contact").collect()] == ["one2@x.es"]
    assert store.read("snapshot").count() == 1


def test_refuses_bad_names(spark, tmp_path):
    analysis, more = part(spark, [1], "x")
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).save("a/b", JAN, analysis)
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).save("a", JAN, analysis, other=analysis)
    assert columns_of(APPENDED["evidence"])[:2] == ["business_id", "code"]
