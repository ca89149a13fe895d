"""Landed months, employees by bitmap, parsed declarations, intervals, months in one pass."""

import os
import random
from decimal import Decimal as D

import pytest
from payroll_rows import JULY, Payroll
from pyspark.sql import functions as F
from test_plans import conf, plan  # noqa: F401

from payproof import PayrollAudit, RunParams
from payproof.functions.bounds import interval_of, with_intervals
from payproof.sources.tables import SEPARATOR
from payproof.store import bucketed
from payproof.store.declaration_store import DeclarationStore
from payproof.store.manifest import Manifest
from payproof.store.payroll_store import PayrollStore, bit_is_set, in_bitmaps, settled_bitmaps
from workload import mapping, queries


def rows(df):
    return sorted(map(str, df.collect()))


def a_payroll(seed=3, employees=40):
    rng = random.Random(seed)
    p = Payroll()
    for key in range(1, employees + 1):
        p.employee(key, rows=1 + (key % 7 == 0), tax_ids=1 + (key % 11 == 0), condition=1 + key % 2)
    for _ in range(200):
        items = [(rng.choice((1, 2, 4, 10, 11, 99)), None, None) for _ in range(rng.randint(0, 4))]
        items = [
            (i, None, str(rng.randint(1, 900))) if i in (10, 11) else (i, str(D(rng.randint(1, 90_000)) / 100), None) for i, _, _ in items
        ]
        kind = rng.choice(("Men", "Emb"))
        p.pay(rng.randint(1, employees - 5), rng.randint(1, 9), *items, kind=kind, year=rng.choice((2024, 2024, 2023)))
    return p


REPORTS = ("pay_summary", "withholding_control", "f931_bases", "taxable_pay_base", "income_tax_control")
SOURCES = ("settlement_lines", "employee_attributes", "enriched_lines", "period_months", "period_years")


@pytest.fixture(scope="module")
def payroll():
    return a_payroll()


@pytest.fixture(scope="module")
def stored(spark, payroll, tmp_path_factory):
    a = payroll.audit(spark)
    store = PayrollStore(spark, str(tmp_path_factory.mktemp("store")), buckets=4)
    a.land_in(store)
    return a, a.on_store(store)


# The sheets of the fixture are of 2024.
CASES = [(name, {}) for name in REPORTS + SOURCES]
CASES += [(name, {"settlement_type": "Emb", "month": 4}) for name in ("pay_summary", "taxable_pay_base", *SOURCES[:2])]
CASES += [(name, {"year": year, "month": 12}) for year in (2023, 2020) for name in ("taxable_pay_base", *SOURCES[:2])]


@pytest.mark.parametrize(("name", "changes"), CASES)
def test_a_store_gives_the_same_rows(stored, name, changes):
    a, on_store = (x.with_params(**changes) for x in stored)
    assert rows(getattr(on_store, name)) == rows(getattr(a, name))


def test_bucketed_lines_join_without_a_shuffle(stored, conf):  # noqa: F811
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(stored[1].period_lines)
    assert "Exchange" not in text and "SortMergeJoin" in text
    assert text.count("PartitionFilters: [") == 2 and "SelectedBucketsCount: 4 out of 4" in text
    for filters in [line for line in text.split("\n") if line.startswith("PartitionFilters")]:
        assert "2024" in filters and "<= 7" in filters
    assert text.count("month=") == 0 or "month=8" not in text


def test_attributes_are_told_by_bitmaps(stored):
    text = plan(stored[1].employee_attributes)
    assert "bitmap_or_agg" in text and "/lines/" not in text and "/headers/" not in text and "sums" not in text


def test_bitmaps_hold_any_number(spark):
    ids = [1, 2, 32768, 32769, 7 * 10**12, 65536, -5, 0]
    absent = [3, 32767, 32770, 7 * 10**12 + 1, 65535, 65537, -4, 5]
    sums = spark.createDataFrame([(i,) for i in ids], "employee_id long").selectExpr("*", "'Men' settlement_type", "2024 year", "7 month")
    people = spark.createDataFrame([(i, "own_bits") for i in ids + absent], "employee_id long, own_bits string")
    found = in_bitmaps(people.select("employee_id"), settled_bitmaps(sums))
    assert sorted(r.employee_id for r in found.collect()) == sorted(ids)
    bits = spark.range(16).select(bit_is_set(F.unhex(F.lit("8001")), F.col("id")).alias("b")).collect()
    assert [i for i, r in enumerate(bits) if r.b] == [7, 8]


def test_landing_a_month_leaves_the_sums_of_the_others(spark, tmp_path):
    p = a_payroll(seed=5)
    store = PayrollStore(spark, str(tmp_path), buckets=4)
    p.audit(spark).land_in(store)
    before = store.manifest.entries()
    p.pay(3, 7, (1, "1000.00", None), (10, None, "7.00")).pay(39, 7, (1, "5.00", None))
    a = p.audit(spark)
    a.land_in(store, [(2024, 7)])
    after = store.manifest.entries()
    assert {k for k in after if after[k] != before.get(k)} == {"sums/2024-07", "settled/2024-07"}
    for name in ("pay_summary", "f931_bases", "employee_attributes"):
        assert rows(getattr(a.on_store(store), name)) == rows(getattr(a, name))
    # The sums of June are the files of the first landing, those of July of the second; no line is read for the reports.
    def folders(entries):
        return {entries[f"sums/2024-{month:02d}"].split("/data/")[1] for month in range(1, 8)}

    read = {os.path.dirname(path).split("/data/")[-1].replace("%3D", "=") for path in a.on_store(store).f931_bases.inputFiles()}
    assert folders(after) <= read and not (folders(before) - folders(after)) & read
    assert not [path for path in read if "/lines/" in path or "/headers/" in path]


def test_landing_a_month_again_takes_out_what_is_gone(spark, tmp_path):
    p = Payroll().employee(1).employee(2)
    p.pay(1, 6, (1, "80.00", None)).pay(1, 7, (1, "500.00", None)).pay(2, 7, (1, "70.00", None))
    store = PayrollStore(spark, str(tmp_path), buckets=2)
    p.audit(spark).land_in(store)
    p.settlements = p.settlements[:1]
    a = p.audit(spark)
    a.land_in(store, [(2024, 7), (2024, 8)])
    on_store = a.on_store(store)
    assert [r.month for r in on_store.period_lines.collect()] == [6]
    assert {r.employee_id for r in on_store.employee_attributes.collect()} == {1}
    assert [r.total for r in on_store.f931_bases.collect()] == [D("0.00")]
    a.land_in(store)
    assert store.manifest.entries().keys() == {"sums/2024-06", "settled/2024-06"}


def test_an_empty_payroll_lands(spark, tmp_path):
    a = Payroll().employee(1).audit(spark)
    store = PayrollStore(spark, str(tmp_path), buckets=2)
    a.land_in(store)
    assert a.on_store(store).pay_summary.count() == 0 and a.on_store(store).employee_attributes.count() == 0


def test_a_settlement_of_many_lines_is_dealt_to_parts(spark, tmp_path, monkeypatch):
    p = Payroll().employee(1).employee(2)
    amounts = [str(D(i) / 100) for i in range(1, 1001)]
    p.pay(1, 7, *((1, x, None) for x in amounts)).pay(2, 7, (1, "3.00", None), (1, "3.00", None))
    a = p.audit(spark)
    lines = bucketed.BucketedLines(spark, str(tmp_path), buckets=8, part_lines=100)
    lines.land(a.tables.settlements, a.tables.lines)
    of_part = spark.table(lines._tables["lines"]).groupBy("settlement_id", "part").count().collect()
    assert len([r for r in of_part if r.settlement_id == 1]) == 10 and max(r["count"] for r in of_part) < 150
    assert rows(lines.period_lines(JULY)) == rows(a.period_lines.select(*lines.period_lines(JULY).columns))
    assert lines.settlements.count() == 2


def test_a_session_that_does_not_know_the_tables_finds_them(spark, payroll, tmp_path):
    a, path = payroll.audit(spark), str(tmp_path)
    store = PayrollStore(spark, path, buckets=4)
    a.land_in(store)
    expected = rows(a.on_store(store).settlement_lines)
    for table in store.lines._tables.values():
        spark.sql(f"DROP TABLE {table}")  # external: the files stay
    assert rows(a.on_store(PayrollStore(spark, path, buckets=4)).settlement_lines) == expected


def test_settlements_without_type_of_their_own_in_lines(spark, tmp_path):
    """Two types that number their own settlements keep their lines apart."""
    p = Payroll().employee(1).employee(2)
    p.pay(1, 7, (1, "5.00", None), kind="Emb").pay(2, 7, (1, "7.00", None), kind="Men")
    t = p.tables(spark)
    same_number = t.settlements.withColumn("settlement_id", F.lit(1).cast("long"))
    of_type = F.when(F.col("settlement_id") == 1, "Emb").otherwise("Men")
    lines = t.lines.withColumn("settlement_type", of_type).withColumn("settlement_id", F.lit(1).cast("long"))
    store = bucketed.BucketedLines(spark, str(tmp_path), buckets=2)
    store.land(same_number, lines)
    got = store.period_lines(JULY).select("settlement_type", "employee_id", "earning").collect()
    assert sorted(map(tuple, got)) == [("Emb", 1, D("5.00")), ("Men", 2, D("7.00"))]


# Declarations


def xml(key, kin=1, amount="10.00", extra=""):
    return (
        f"<d><empleado><cuit>{key}</cuit></empleado><cargaFamilia><parentesco>{kin}</parentesco><mesDesde>1</mesDesde>"
        f"<mesHasta>12</mesHasta><porcentajeDeduccion>100</porcentajeDeduccion></cargaFamilia>"
        f'<deduccion tipo="2"><montoTotal>{amount}</montoTotal></deduccion>{extra}</d>'
    )


def put(folder, name, text, at):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    os.utime(path, (at, at))


def test_only_new_and_changed_declarations_are_parsed(spark, tmp_path):
    folder, now = tmp_path / "xml", 1_700_000_000
    folder.mkdir()
    store = DeclarationStore(spark, str(folder), str(tmp_path / "parsed"))
    assert store.ingest() == 0 and store.entries().count() == 0
    put(folder, "a.xml", "﻿" + xml("2001"), now)
    put(folder, "b.xml", xml("2002", amount="20.50"), now)
    put(folder, "empty.xml", "", now)
    put(folder, "other.txt", "no declaration", now)
    assert store.ingest() == 2  # an empty file has nothing to read
    assert store.ingest() == 0
    amounts = lambda: sorted((r.tax_id, r.amount) for r in store.entries().where("code is not null").collect())
    assert amounts() == [("2001", D("10.00")), ("2002", D("20.50"))]
    # A changed file, a new one of an older time, and one that is gone.
    put(folder, "b.xml", xml("2002", amount="30.00"), now + 5)
    put(folder, "c.xml", xml("2003"), now - 500)
    (folder / "a.xml").unlink()
    assert store.ingest() == 2
    assert amounts() == [("2002", D("30.00")), ("2003", D("10.00"))]
    assert store.entries().where("kinship is not null").count() == 2


def test_a_file_of_several_declarations(spark, tmp_path):
    folder, now = tmp_path / "xml", 1_700_000_000
    folder.mkdir()
    store = DeclarationStore(spark, str(folder), str(tmp_path / "parsed"))
    several = [xml(f"20{i:02d}", amount=f"{i}.00\n") for i in range(30)]
    put(folder, "a+b %20é.xml", "\ufeff" + f"{SEPARATOR}\ufeff".join(several) + SEPARATOR, now)
    put(folder, "one.xml", xml("2099", amount="99.00"), now)
    assert store.ingest() == 2 and store.ingest() == 0
    amounts = lambda: sorted((r.tax_id, r.amount) for r in store.entries().where("code is not null").collect())
    assert amounts() == [(f"20{i:02d}", D(i)) for i in (*range(30), 99)]
    # One of them changed and another gone: the file is parsed again, and what it held before drops out.
    put(folder, "a+b %20é.xml", SEPARATOR.join([*several[:28], xml("2028", amount="7.00")]), now + 5)
    assert store.ingest() == 1
    assert amounts() == [(f"20{i:02d}", D(i)) for i in range(28)] + [("2028", D("7.00")), ("2099", D("99.00"))]
    put(folder, "bad.xml", SEPARATOR.join([several[0], "<d><deduccion tipo='2'></deduccion></d>"]), now)
    with pytest.raises(Exception, match="declaration without"):
        store.ingest()


def test_small_files_are_read_many_to_a_task(spark, tmp_path, conf):  # noqa: F811
    folder, tasks = tmp_path / "xml", 4 * spark.sparkContext.defaultParallelism
    folder.mkdir()
    conf(files__openCostInBytes="1g", shuffle__partitions="2")  # as if Spark dealt each task one file
    for i in range(2 * tasks):
        put(folder, f"{i}.xml", xml(f"2{i:03d}"), 1_700_000_000 + i)
    store = DeclarationStore(spark, str(folder), str(tmp_path / "parsed"))
    assert store.ingest() == 2 * tasks and store.ingest() == 0
    assert store.entries().select("tax_id").distinct().count() == 2 * tasks
    # As many files as tasks wrote them, both for a listing that meets nothing landed and for the documents.
    for written in tmp_path.glob("parsed/data/*/*"):
        assert len(list(written.glob("part-*"))) <= tasks


def test_the_ingested_query_writes_few_files(spark, tmp_path, monkeypatch):
    spark.range(600).selectExpr(
        "id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "CAST(id % 7 AS DOUBLE) AS c_acctbal", "'s' AS c_mktsegment"
    ).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([], mapping.FILES["orders"]).write.parquet(str(tmp_path / "orders.parquet"))
    numbers = iter(range(9))
    monkeypatch.setattr(queries, "scratch_folder", lambda spark: str(tmp_path / f"scratch{next(numbers)}"))
    ingested = queries.queries()["f572_deductions_ingested"](spark, str(tmp_path))
    expected = queries.queries()["f572_deductions"](spark, str(tmp_path))
    assert rows(ingested) == rows(expected) and expected.count() > 514
    # 514 declarations, in a file for each task that wrote some.
    assert len(list(tmp_path.glob("scratch*/*.txt"))) <= spark.sparkContext.defaultParallelism


def test_a_bad_declaration_keeps_nothing_of_its_batch(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    store = DeclarationStore(spark, str(folder), str(tmp_path / "parsed"))
    put(folder, "a.xml", xml("2001"), 1_700_000_000)
    put(folder, "bad.xml", "<d><deduccion tipo='2'></deduccion></d>", 1_700_000_000)
    with pytest.raises(Exception, match="declaration without"):
        store.ingest()
    assert store.entries().count() == 0
    (folder / "bad.xml").unlink()
    assert store.ingest() == 1 and store.entries().count() == 2


def test_reports_read_parsed_declarations(spark, tmp_path):
    p = Payroll().employee(1).pay(1, 7, (1, "900000.00", None))
    p.deduct(1, c2="100.00", c22="50.00").declaration(1, "<cargaFamilia><parentesco>1</parentesco><mesDesde>1</mesDesde>"
        "<mesHasta>12</mesHasta><porcentajeDeduccion>100</porcentajeDeduccion></cargaFamilia>")  # fmt: skip
    folder = tmp_path / "xml"
    folder.mkdir()
    for name, text in p.declared:
        (folder / f"{name}.xml").write_text(text)
    store = DeclarationStore(spark, str(folder), str(tmp_path / "parsed"))
    store.ingest()
    a = p.audit(spark)
    b = a.on_entries(store.entries())
    for name in ("f572_dependants", "f572_deductions", "income_tax_control"):
        assert rows(getattr(a, name)) == rows(getattr(b, name)), name
    assert "from_xml" not in plan(b.income_tax_control)


def test_the_income_tax_from_one_file_of_all_declarations(spark, tmp_path):
    p = Payroll()
    for key in range(1, 6):
        p.employee(key).pay(key, 7, (1, f"{key}00000.00", None)).deduct(key, c2=f"{key}0.00", c22="50.00")
    a = p.audit(spark)
    folder = tmp_path / "xml"
    folder.mkdir()
    (folder / "all.xml").write_text(SEPARATOR.join(text for _, text in p.declared))
    parsed = DeclarationStore(spark, str(folder), str(tmp_path / "parsed"))
    assert parsed.ingest() == 1
    store = PayrollStore(spark, str(tmp_path / "store"), buckets=2)
    a.land_in(store)
    stored = a.on_store(store).on_entries(parsed.entries()).income_tax_control
    assert rows(stored) == rows(a.income_tax_control) and stored.where("rent_40 <> 0").count() == 5


# Manifest


def test_a_manifest_shows_the_latest_commit(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.entries() == {}
    m.commit({"a": "x", "b": "y"})
    m.commit({"a": "z"}, removed=["a", "b"])
    assert m.entries() == {"a": "z"} and Manifest(spark, str(tmp_path)).entries() == {"a": "z"}
    m.commit({}, removed=["a"])
    assert m.entries() == {}
    assert m.read(["a"], "n INT").count() == 0


# Intervals


def brackets(spark, data):
    return spark.createDataFrame(data, "status string, lower int, upper int, rate int")


def test_intervals_by_bisection_equal_a_search(spark):
    rng = random.Random(2)
    data = []
    for status in ("Activo", "Baja", "Other"):
        edges = sorted(rng.sample(range(1000), 61))
        pairs = [(a, b) for a, b in zip(edges, edges[1:]) if rng.random() < 0.8]  # gaps too
        data += [(status, a, b, i) for i, (a, b) in enumerate(pairs)]
    data += [("Activo", 1500, 1400, -1), ("Baja", None, 5, -1)]  # hold nothing
    rng.shuffle(data)
    values = [(s, v) for s in ("Activo", "Baja", "Other", "None") for v in [*range(-5, 1010, 3), None]] + [(None, 3)]
    df = spark.createDataFrame(values, "status string, gain int")
    indexed = with_intervals(df, "scale", brackets(spark, data), "status", "lower", "upper")
    got = interval_of(indexed, "bracket", "scale", "status", "gain", "upper").select("status", "gain", "bracket.rate").collect()

    def search(s, v):
        fits = [r for st, a, b, r in data if st == s and None not in (a, v) and a < v <= b]
        return fits[0] if fits else None

    assert [(r.status, r.gain, r.rate) for r in got] == [(s, v, search(s, v)) for s, v in values]


def test_overlapping_and_many_intervals_fail(spark):
    df = spark.createDataFrame([("a", 1)], "status string, gain int")
    with pytest.raises(Exception, match="intervals overlap"):
        with_intervals(df, "scale", brackets(spark, [("a", 0, 5, 1), ("a", 4, 9, 2)]), "status", "lower", "upper").collect()
    with pytest.raises(Exception, match="more than 2 rows"):
        with_intervals(df, "scale", brackets(spark, [("a", i, i + 1, 1) for i in range(3)]), "status", "lower", "upper", 2).collect()
    none = with_intervals(df, "scale", brackets(spark, []), "status", "lower", "upper")
    assert interval_of(none, "bracket", "scale", "status", "gain", "upper").first().bracket is None


# Months in one pass


@pytest.mark.parametrize("options", [{}, {"sac_mode": "annual"}, {"prorate_irregular": False}, {"settlement_type": "Men"}])
def test_every_month_of_the_year_from_one_pass(spark, payroll, options):
    a = PayrollAudit(payroll.tables(spark), RunParams(2024, 7, **options))
    got = {}
    for r in a.taxable_pay_base_by_month.collect():
        got.setdefault(r.month, []).append(str(r))
    for month in (1, 4, 7, 12) if not options else (5, 7):
        assert sorted(got.get(month, [])) == rows(a.with_params(month=month).taxable_pay_base), month
