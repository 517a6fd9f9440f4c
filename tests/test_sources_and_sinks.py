import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.windows import dedupe_first
from tidemark.plans.jobs import LoadConfig, backfill, incremental_load, refresh_features
from tidemark.sinks import tables
from tidemark.sources import files
from tidemark.sources.schemas import PREDICTIONS, PRICES, TABLES
from tidemark.streaming.arrivals import stream_prices

PRICE_HEAD = "Barra\tRef\tFecha\tHora\tUSD\tCLP\tNombre"


def price_file(path, *rows):
    path.write_text("\n".join([PRICE_HEAD, *["\t".join(r) for r in rows]]) + "\n", encoding="utf-8")
    return str(path)


def price(day, hour, usd, bus="BA01"):
    return (bus, "BA02", day, str(hour), usd, "1", "Quillota")


def utc(df):
    return [tuple(r) for r in df.select(F.col("datetime").cast("string"), "cmg_usd_mwh").orderBy("datetime", "cmg_usd_mwh").collect()]


def test_price_rows_are_typed_and_named(spark, tmp_path):
    path = price_file(tmp_path / "p.tsv", price("2024-03-10", 1, "59,80"), price("2024-03-10", 2, "62,50"), price("2024-03-10", 3, "110,25"))
    df = files.read_price_tsv(spark, path, barra="Quillota 220kV")
    assert [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema] == ["datetime:timestamp", "barra:string", "cmg_usd_mwh:double"]
    assert utc(df) == [("2024-03-10 03:00:00", 59.8), ("2024-03-10 04:00:00", 62.5), ("2024-03-10 05:00:00", 110.25)]
    assert {r["barra"] for r in df.collect()} == {"Quillota 220kV"}


def test_bus_codes_translate_when_no_constant_is_given(spark, tmp_path):
    path = price_file(tmp_path / "p.tsv", price("2024-03-10", 1, "1"), price("2024-03-10", 1, "2", "BA09"))
    df = files.read_price_tsv(spark, path, bus_map={"BA01": "North"}, barra=None)
    assert {r["barra"]: r["cmg_usd_mwh"] for r in df.collect()} == {"North": 1.0, "BA09": 2.0}


def test_unusable_lines_are_rejected_with_a_reason_and_short_ones_kept(spark, tmp_path):
    short, long = price("2024-03-10", 4, "7")[:6], (*price("2024-03-10", 5, "8"), "more")
    path = price_file(
        tmp_path / "p.tsv", price("2024-03-10", 1, "1"), price("2024-99-10", 1, "2"), price("2024-03-10", "x", "3"), ("cut", "off"), short, long
    )
    assert utc(files.read_price_tsv(spark, path)) == [("2024-03-10 03:00:00", 1.0), ("2024-03-10 06:00:00", 7.0)]
    bad = files.rejected_prices(spark, path).orderBy("line").collect()
    assert [r["reason"] for r in bad] == ["too many cells", "no usable time", "no usable time", "no usable time"] or sorted(
        r["reason"] for r in bad
    ) == ["no usable time"] * 3 + ["too many cells"]
    assert bad[-1]["line"] == "cut\toff" and all(r["file"].endswith("p.tsv") for r in bad)
    path = price_file(tmp_path / "p.tsv", price("2024-03-10", 1, "1"), price("2024-99-10", 1, "2"), price("2024-03-10", "x", "3"), ("cut", "off"))
    fitting, misfit = files.scan_glob(spark, path, files.text_schema(files.PRICE_COLUMNS), sep="\t")
    assert fitting.select("fecha").count() == 3 and misfit.select("_corrupt").first()[0] == "cut\toff"


def test_spring_hour_keeps_the_earlier_file_hour(spark, tmp_path):
    path = price_file(tmp_path / "p.tsv", price("2023-09-03", 2, "20"), price("2023-09-03", 1, "10"), price("2023-09-03", 3, "30"))
    rows = files.read_price_tsv(spark, path, keep_hour=True)
    first = dedupe_first(rows, ["datetime", "barra"], ["file_hour"])
    assert utc(first) == [("2023-09-03 04:00:00", 10.0), ("2023-09-03 05:00:00", 30.0)]


HOURS = "\t".join(files.HOUR_COLUMNS)


def generation_file(path, *rows):
    lines = ["\ufeffTipo\t Subtipo \tFecha\tCentral\t" + HOURS]
    for kind, sub, day, cells in rows:
        lines.append("\t".join([kind, sub, day, "P1", *cells]))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_generation_sums_plants_and_fills_technologies(spark, tmp_path):
    one, blank = ["1,5"] * 24, ["NA"] + ["2,0"] * 23
    path = generation_file(
        tmp_path / "g.tsv",
        ("Solar", "x", "2024-01-15", one), ("Solar", "y", "2024-01-15", one), ("Termoeléctricas", "Diésel", "2024-01-15", blank),
        ("Termoeléctricas", "Biomasa", "2024-01-15", one), ("Otra", "Embalse", "2024-01-15", one), ("Solar", "x", "2024-15-15", one),
    )
    rows = files.read_generation_tsv(spark, path).orderBy("datetime").collect()
    assert len(rows) == 24
    assert str(rows[0]["datetime"]) == "2024-01-15 03:00:00"
    assert (rows[0]["gen_solar_mw"], rows[0]["gen_diesel_mw"], rows[0]["gen_total_mw"]) == (3.0, 0.0, 3.0)
    assert (rows[1]["gen_diesel_mw"], rows[1]["gen_wind_mw"], rows[1]["gen_total_mw"]) == (2.0, 0.0, 5.0)


def test_spring_hour_of_generation_is_summed_or_averaged(spark, tmp_path):
    path = generation_file(tmp_path / "g.tsv", ("Eólicas", "x", "2023-09-03", [str(h) for h in range(1, 25)]))
    assert files.read_generation_tsv(spark, path).orderBy("datetime").first()["gen_wind_mw"] == 3.0
    assert files.read_generation_tsv(spark, path, dst_duplicates="mean").orderBy("datetime").first()["gen_wind_mw"] == 1.5
    assert files.read_generation_tsv(spark, path).count() == 23


def test_generation_without_required_columns_is_an_error(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Tipo\tFecha\nSolar\t2024-01-01\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Subtipo"):
        files.read_generation_tsv(spark, str(tmp_path / "g.tsv"))


def test_reservoirs_by_month(spark, tmp_path):
    text = "FECHA;central;cota_msnm\n" + "\n".join(
        ["01/01/2019;Colbún;400,5", "15/01/2019; Laja ;500,5", "16/01/2019;Laja;NA", "31/12/2018;Laja;1,0",
         "01/02/2019;Otro;9,0", "32/02/2019;Laja;1,0", "28/02/2019;La Invernada;"]
    )
    (tmp_path / "r.csv").write_bytes(b"\xef\xbb\xbf" + text.encode("latin-1"))
    rows = files.read_reservoir_csv(spark, str(tmp_path / "r.csv")).orderBy("date").collect()
    assert [(str(r["date"]), r["avg_cota_msnm"], r["n_embalses"]) for r in rows] == [("2019-01-01", 450.5, 2), ("2019-02-01", None, 1)]


def payload(path, daily):
    path.write_text(json.dumps({"latitude": 1, "daily": daily}) if daily else json.dumps({"x": 1}), encoding="utf-8")
    return str(path)


def test_weather_payload(spark, tmp_path):
    daily = {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [31.5, None], "precipitation_sum": ["x", 0]}
    rows = files.read_weather_json(spark, payload(tmp_path / "w.json", daily)).orderBy("date").collect()
    assert [(str(r["date"]), r["temp_max_c"], r["precip_mm"], r["region"]) for r in rows] == [
        ("2024-01-01", 31.5, None, "Santiago"), ("2024-01-02", None, 0.0, "Santiago"),
    ]
    for broken in (None, {"time": ["2024-01-01"]}):
        with pytest.raises(Exception, match="lacks daily"):
            files.read_weather_json(spark, payload(tmp_path / "b.json", broken)).collect()


def test_insert_keeps_existing_rows(spark, tmp_path):
    schema = "datetime timestamp, barra string, v double, tie int"
    path = str(tmp_path / "t")

    def insert(*rows):
        df = spark.createDataFrame([(datetime(2024, m, 1), b, v, t) for m, b, v, t in rows], schema)
        stored = tables.T.StructType([f for f in df.schema if f.name != "tie"])
        return tables.insert_if_absent(spark, df, path, ["datetime", "barra"], ["tie"], stored), stored

    first, stored = insert((1, "a", 1.0, 2), (1, "a", 2.0, 1), (2, "a", 3.0, 1))
    assert first == {"attempted": 3, "inserted": 2, "ignored": 1}
    second, _ = insert((1, "a", 9.0, 0), (3, "a", 4.0, 0))
    assert second == {"attempted": 2, "inserted": 1, "ignored": 1}
    assert insert((1, "a", 9.0, 0))[0]["inserted"] == 0
    rows = tables.read_table(spark, path, stored).orderBy("datetime").collect()
    assert [(r["v"], r["month"]) for r in rows] == [(2.0, "2024-01"), (3.0, "2024-02"), (4.0, "2024-03")]


def test_insert_of_nothing_writes_nothing_and_bad_keys_are_errors(spark, tmp_path):
    df = spark.createDataFrame([], "datetime timestamp, v double")
    assert tables.insert_if_absent(spark, df, str(tmp_path / "t"), ["datetime"])["inserted"] == 0
    assert not (tmp_path / "t").exists()
    for keys in ([], ["nope"]):
        with pytest.raises(ValueError, match="key columns"):
            tables.insert_if_absent(spark, df, str(tmp_path / "t"), keys)


def test_predictions_are_filtered_and_written_once(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), p, a, n) for h, p, a, n in
            [(0, 1.23456, 2.0, 1), (1, float("nan"), 2.0, 1), (2, None, 2.0, 1), (3, 3.0, float("inf"), 24), (4, 3.0, 1.0, 25)]]
    df = spark.createDataFrame(rows, "datetime timestamp, predicted double, actual double, h int")
    shape = {"barra": "Quillota 220kV", "model_name": "m", "model_version": "1.0", "horizon_h": "h"}
    assert tables.write_predictions(spark, df, str(tmp_path), **shape) == {"attempted": 5, "inserted": 2, "ignored": 0, "rejected": 3}
    assert tables.write_predictions(spark, df, str(tmp_path), **shape)["inserted"] == 0
    stored = tables.read_table(spark, f"{tmp_path}/predictions", PREDICTIONS).orderBy("datetime").collect()
    assert [(float(r["predicted_cmg"]), r["actual_cmg"] and float(r["actual_cmg"]), r["horizon_h"]) for r in stored] == [
        (1.2346, 2.0, 1), (3.0, None, 24)]


def config(tmp_path, **more):
    days = [f"2024-01-{d:02d}" for d in range(10, 14)]
    price_file(tmp_path / "cmg_1.tsv", *[price(d, h, "50,0") for d in days[:2] for h in range(1, 25)])
    price_file(tmp_path / "cmg_2.tsv", *[price(d, h, "-1" if h == 5 else "60,0") for d in days[2:] for h in range(1, 25)])
    generation_file(tmp_path / "gen.tsv", *[("Solar", "x", d, ["5,0"] * 24) for d in days])
    (tmp_path / "res.csv").write_bytes("fecha;central;cota_msnm\n05/01/2024;Colbún;400,0\n".encode("latin-1"))
    payload(tmp_path / "w.json", {"time": days, "temperature_2m_max": [1, 2, 3, 4], "precipitation_sum": [0, 0, 0, 0]})
    paths = {"prices": str(tmp_path / "cmg_*.tsv"), "generation": str(tmp_path / "gen.tsv"), "reservoirs": str(tmp_path / "res.csv"), "weather": str(tmp_path / "w.json")}
    return LoadConfig(root=str(tmp_path / "out"), **{**paths, **more})


def test_backfill_loads_each_source_once_even_if_one_is_broken(spark, tmp_path):
    cfg = config(tmp_path, reservoirs=str(tmp_path / "missing.csv"))
    loaded = backfill(spark, cfg)
    assert loaded == {"cmg": 96, "generation": 96, "reservoirs": 0, "weather": 4}
    assert list(loaded.failed) == ["reservoirs"]
    assert loaded.details["cmg"] == {"attempted": 96, "inserted": 96, "ignored": 0, "rejected": 0}
    assert backfill(spark, config(tmp_path)) == {"cmg": 0, "generation": 0, "reservoirs": 1, "weather": 0}
    stored = tables.read_table(spark, f"{cfg.root}/marginal_costs", PRICES)
    assert stored.where("is_imputed").count() == 2
    assert {float(r[0]) for r in stored.where("is_imputed").select("cmg_usd_mwh").collect()} == {60.0}
    gen = tables.read_table(spark, f"{cfg.root}/generation_by_tech", TABLES["generation_by_tech"])
    night = gen.where("gen_solar_mw = 0").count()
    assert night == 4 * 9


def test_incremental_load_takes_one_day(spark, tmp_path):
    cfg = config(tmp_path)
    assert incremental_load(spark, cfg, "2024-01-12") == {"cmg": 24, "generation": 24, "reservoirs": 1, "weather": 1}
    assert incremental_load(spark, cfg, "2024-01-12") == {"cmg": 0, "generation": 0, "reservoirs": 0, "weather": 0}
    assert incremental_load(spark, cfg, "2024-01-13")["cmg"] == 24
    assert backfill(spark, cfg)["cmg"] == 48


def test_two_buses_rejected_lines_and_unreadable_overlaps(spark, tmp_path):
    day = "2024-01-10"
    price_file(tmp_path / "a.tsv", *[price(day, h, "50,0", bus) for bus in ("BA01", "BA02") for h in range(1, 25)], ("cut", "off"))
    price_file(tmp_path / "b.tsv", price(day, 7, "?", "BA01"), price(day, 8, "", "BA02"))
    cfg = LoadConfig(root=str(tmp_path / "out"), prices=[str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    loaded = backfill(spark, cfg)
    # Two lines repeat an hour, and count as ignored.
    assert loaded.details["cmg"] == {"attempted": 51, "inserted": 48, "ignored": 2, "rejected": 1} and not loaded.failed
    stored = tables.read_table(spark, f"{cfg.root}/marginal_costs", PRICES)
    assert stored.where("is_imputed").count() == 0 and {r[0] for r in stored.select("barra").collect()} == {"BA01", "BA02"}
    assert spark.read.parquet(f"{cfg.root}/quarantine/prices").select("line", "reason").collect() == [("cut\toff", "no usable time")]
    again = backfill(spark, cfg).details["cmg"]
    assert again == {"attempted": 51, "inserted": 0, "ignored": 50, "rejected": 1}
    assert spark.read.parquet(f"{cfg.root}/quarantine/prices").groupBy("load").count().count() == 2
    became = spark.read.parquet(f"{cfg.root}/outcomes/prices").where(F.col("load") == loaded.name).orderBy("file").collect()
    assert [(r["file"][-5:], r["n_lines"], r["used"], r["other"], r["rejected"], r["error"]) for r in became] == [
        ("a.tsv", 49, 48, 0, 1, None), ("b.tsv", 2, 2, 0, 0, None),
    ]


def test_a_given_bus_name_rejects_no_line_without_a_code(spark, tmp_path):
    rows = [price("2024-01-10", h, "50,0", "" if h == 3 else "BA01") for h in range(1, 25)]
    path = price_file(tmp_path / "a.tsv", *rows, rows[0], rows[1])
    assert [r["reason"] for r in files.rejected_prices(spark, path).collect()] == ["no bus"]
    assert files.rejected_prices(spark, path, barra="B").count() == 0
    named = backfill(spark, LoadConfig(root=str(tmp_path / "named"), prices=path, barra="B")).details["cmg"]
    assert named == {"attempted": 26, "inserted": 24, "ignored": 2, "rejected": 0}
    coded = backfill(spark, LoadConfig(root=str(tmp_path / "coded"), prices=path)).details["cmg"]
    assert coded == {"attempted": 26, "inserted": 23, "ignored": 2, "rejected": 1}


def hours_of(day, cells, order=None, extra=()):
    names = ["Tipo", "Subtipo", "Fecha", *files.HOUR_COLUMNS, *extra]
    row = dict(zip(names, ["Solar", "x", day, *cells, *extra], strict=True))
    names = sorted(names, key=order) if order else names
    return "\t".join(names), "\t".join(row[n] for n in names)


def test_files_with_their_own_column_order(spark, tmp_path):
    cells = [f"{h},25" for h in range(24)]
    layouts = [None, lambda n: n[::-1], lambda n: (len(n), n)]
    for i, order in enumerate(layouts):
        head, row = hours_of(f"2024-01-1{i}", cells, order, extra=["Nota"] * (i == 2))
        (tmp_path / f"g {i}.tsv").write_text(f"{head}\n{row}\n{head}\n\n", encoding="utf-8")
    got = files.read_generation_tsv(spark, str(tmp_path / "g *.tsv")).orderBy("datetime").collect()
    assert [r["gen_solar_mw"] for r in got] == [h + 0.25 for h in range(24)] * 3
    text = ["fecha;central;cota_msnm\n01/01/2019;Colbún;400,5\n", 'cota_msnm;"nota; x";central; Fecha \n500,5;"a;""b""";Laja;15/01/2019\n']
    for i, x in enumerate(text):
        (tmp_path / f"r{i}.csv").write_bytes(b"\xef\xbb\xbf" * i + x.encode("latin-1"))
    month = files.read_reservoir_csv(spark, str(tmp_path / "r*.csv")).collect()
    assert [(str(r["date"]), r["avg_cota_msnm"], r["n_embalses"]) for r in month] == [("2019-01-01", 450.5, 2)]


def test_broken_files_keep_no_other_from_loading(spark, tmp_path):
    cells = ["1,0"] * 24
    good = "\n".join(hours_of("2024-01-10", cells))
    (tmp_path / "good.tsv").write_text(good + "\n" + "\t".join(["Solar", "x", "2024-99-99", *cells]) + "\nOtra\tx\t2024-01-10\n", encoding="utf-8")
    (tmp_path / "lacks.tsv").write_text("Tipo\tFecha\nSolar\t2024-01-01\n", encoding="utf-8")
    (tmp_path / "empty.tsv").write_text("")
    whole = gzip.compress("\n".join([good, *[good.split("\n")[1]] * 5000]).encode())
    (tmp_path / "cut.tsv.gz").write_bytes(whole[: len(whole) // 2])
    cfg = LoadConfig(root=str(tmp_path / "out"), generation=str(tmp_path / "*.tsv*"))
    loaded = backfill(spark, cfg)
    assert loaded["generation"] == 24 and not loaded.failed
    broken = {f.rsplit("/", 1)[1]: e for f, e in loaded.failed_files["generation"].items()}
    assert set(broken) == {"lacks.tsv", "empty.tsv", "cut.tsv.gz"}
    assert broken["empty.tsv"] == "no lines" and broken["lacks.tsv"].startswith("missing columns Hora 1, Hora 10")
    became = spark.read.parquet(f"{cfg.root}/outcomes/generation").where("error IS NULL").collect()
    assert [(r["n_lines"], r["used"], r["other"], r["rejected"]) for r in became] == [(3, 1, 1, 1)]
    assert spark.read.parquet(f"{cfg.root}/quarantine/generation").first()["reason"] == "no usable date"
    with pytest.raises(ValueError, match="missing columns|no lines|cut"):
        files.read_generation_tsv(spark, str(tmp_path / "*.tsv*"))
    only = backfill(spark, LoadConfig(root=str(tmp_path / "none"), generation=str(tmp_path / "lacks.tsv")))
    assert "missing columns" in only.failed["generation"]


def test_outcomes_of_scanned_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tv\n1\t2\n3\n")
    (tmp_path / "b.tsv").write_text("k\tv\n5\t6\n")
    whole = gzip.compress(("k\tv\n" + "".join(f"{i}\t{i * 7919 % 10007}\n" for i in range(50000))).encode())
    (tmp_path / "c.tsv.gz").write_bytes(whole[: len(whole) // 2])
    good, bad, became = files.scan_files(spark, str(tmp_path / "*.tsv*"), files.text_schema(["k", "v"]), sep="\t")
    assert sorted(r["k"] for r in good.collect()) == ["1", "5"] and bad.count() == 1
    rows = {r["file"].rsplit("/", 1)[1]: r for r in became.collect()}
    assert [(n, r["n_lines"], r["used"], r["rejected"], r["error"] is None) for n, r in sorted(rows.items())] == [
        ("a.tsv", 2, 1, 1, True), ("b.tsv", 1, 1, 0, True), ("c.tsv.gz", 0, 0, 0, False),
    ]
    assert "nexpected end" in rows["c.tsv.gz"]["error"]


def test_broken_price_and_weather_files(spark, tmp_path):
    cfg = config(tmp_path)
    whole = gzip.compress(("\n".join([PRICE_HEAD, *["\t".join(price("2024-01-10", 1, str(i))) for i in range(20000)]])).encode())
    (tmp_path / "cmg_9.tsv.gz").write_bytes(whole[: len(whole) // 2])
    payload(tmp_path / "w2.json", None)
    cfg = LoadConfig(root=cfg.root, prices=str(tmp_path / "cmg_*"), weather=str(tmp_path / "w*.json"))
    loaded = backfill(spark, cfg)
    assert (loaded["cmg"], loaded["weather"]) == (96, 4) and not loaded.failed
    assert {s: [f.rsplit("/", 1)[1] for f in e] for s, e in loaded.failed_files.items()} == {"prices": ["cmg_9.tsv.gz"], "weather": ["w2.json"]}


def test_arriving_files_are_loaded_once_and_late_rows_fill_holes(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    price_file(box / "a.tsv", price("2024-01-10", 1, "10"), price("2024-01-10", 2, "-5"), price("2024-01-10", 3, ""))

    def load():
        stream_prices(spark, str(box), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
        return utc(tables.read_table(spark, f"{tmp_path}/out/marginal_costs", PRICES).withColumn("cmg_usd_mwh", F.col("cmg_usd_mwh").cast("double")))

    assert load() == [("2024-01-10 03:00:00", 10.0)]
    price_file(box / "b.tsv", price("2024-01-10", 1, "99"), price("2024-01-10", 2, "20"))
    assert load() == [("2024-01-10 03:00:00", 10.0), ("2024-01-10 04:00:00", 20.0)]


def test_a_load_killed_midway_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    schema = "datetime timestamp, v double"

    def rows(*days):
        return spark.createDataFrame([(datetime(2024, 1, d), float(d)) for d in days], schema)

    def stored():
        return sorted(r["v"] for r in tables.read_table(spark, path, rows(1).schema).collect())

    def killed(*_):
        raise KeyboardInterrupt

    for days, before in (((1, 2), []), ((2, 3), [1.0, 2.0])):
        with monkeypatch.context() as m:
            m.setattr(tables, "commit_load", killed)
            with pytest.raises(KeyboardInterrupt):
                tables.insert_if_absent(spark, rows(*days), path, ["datetime"])
        assert stored() == before
        assert tables.insert_if_absent(spark, rows(*days), path, ["datetime"])["inserted"] == len(set(days) - set(map(int, before)))
    assert stored() == [1.0, 2.0, 3.0] and len(tables.committed_loads(spark, path)) == 2


def test_a_batch_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(datetime(2024, 1, d), float(d)) for d in range(1, 6)], "datetime timestamp, v double")
    got = tables.insert_if_absent(spark, df.mapInPandas(counted, df.schema), str(tmp_path / "t"), ["datetime"])
    assert got == {"attempted": 5, "inserted": 5, "ignored": 0} and seen.value == 5


def test_refresh_replaces_touched_months_only(spark, tmp_path):
    root = str(tmp_path)

    def load(table, rows, schema):
        tables.load_table(spark, spark.createDataFrame(rows, schema), root, table)

    def features():
        rows = spark.read.parquet(f"{root}/feature_store").orderBy("datetime").collect()
        return [(str(r["datetime"])[:10], r["demand_mw"] and float(r["demand_mw"]), r["temp_max_c"] and float(r["temp_max_c"])) for r in rows]

    hours = [datetime(2024, m, d, 12) for m, d in ((1, 15), (2, 15), (3, 1))]
    load("marginal_costs", [(t, "a", 1.0, False) for t in hours], "datetime timestamp, barra string, cmg_usd_mwh double, is_imputed boolean")
    assert refresh_features(spark, root, "r") == ["2024-01", "2024-02", "2024-03"]
    assert features() == [("2024-01-15", None, None), ("2024-02-15", None, None), ("2024-03-01", None, None)]
    load("demand", [(hours[1], 7.0)], "datetime timestamp, demand_mw double")
    assert refresh_features(spark, root, "r") == ["2024-02"]
    load("weather", [(hours[2].date(), "r", 20.0, 0.0)], "date date, region string, temp_max_c double, precip_mm double")
    # A local day reaches into two UTC days, here of two months.
    assert refresh_features(spark, root, "r") == ["2024-02", "2024-03"]
    assert features() == [("2024-01-15", None, None), ("2024-02-15", 7.0, None), ("2024-03-01", None, 20.0)]
    assert refresh_features(spark, root, "r") == []
