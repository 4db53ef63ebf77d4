"""Command line: ``python -m larkspan.cli COMMAND ...``; measurements and claims are Parquet folders or GeoPackage files."""

from __future__ import annotations

import argparse
import json
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

from larkspan.operators import claims as C
from larkspan.operators import crossval, kriging, readings
from larkspan.plans import runs
from larkspan.sinks import documents
from larkspan.sources import config, gpkg


def _claims(spark: SparkSession, path: str, environment: int) -> DataFrame:
    if not path.endswith(".gpkg"):
        return spark.read.parquet(path).where(f"environmnt = {environment}")
    gpkg.register(spark)
    return spark.read.format("gpkg").option("path", path).option("environment", environment).load()


def audit(spark, a) -> None:
    claims = _claims(spark, a.claims, a.environment)
    audited = runs.audit(readings.as_of(spark.read.parquet(a.measurements), a.as_of), claims, a.environment)
    print(runs.write_audit(audited, a.out_dir, a.prefix)["text"])


def verify(spark, a) -> None:
    """The claims joined by the stricter rule, from a table stored for the box of the points where there is one."""
    from larkspan.sources import extent

    points = readings.as_of(spark.read.parquet(a.measurements), a.as_of).where("rsrp is not null")
    box = C.bounds_of(points, C.CHECK_MARGIN)
    if a.table and a.skip_load:
        near = C.claims_near(extent.reuse(spark, a.table, box), a.environment, box)
    else:
        near = C.claims_near(_claims(spark, a.claims, a.environment), a.environment, box)
        if a.table:
            extent.load(near, a.table, box)
            near = spark.read.parquet(a.table)
    near = near.persist()
    report = documents.clean({"summary": C.check_summary(points, near).first().asDict(), "by_tier": [r.asDict() for r in C.check_by_tier(points, near).collect()]})
    print(json.dumps(report, indent=2))
    if a.json:
        documents.write_report(a.json, report)
    if a.table and not a.keep and not a.skip_load:
        shutil.rmtree(a.table, ignore_errors=True)


def publish(spark, a) -> None:
    rows, claims = spark.read.parquet(a.measurements), _claims(spark, a.claims, a.environment).persist()
    out = runs.publish(rows, claims, runs.audit(readings.as_of(rows, a.as_of), claims, a.environment), a.out, a.min_measurements, a.as_of)
    print(f"{out.count()} hexes in {a.out}")


def stats(spark, a) -> None:
    rows = spark.read.parquet(a.measurements)
    report = {"totals": readings.totals(rows).first().asDict(), "rereads": readings.rereads(rows).first().asDict(), "per_session": [r.asDict() for r in readings.per_session(rows).orderBy("started_at").toLocalIterator()]}
    print(json.dumps(documents.clean(report), default=str, indent=2))


def _config(a) -> config.Config:
    return config.Config.from_env(output_dir=a.out_dir, kriging=a.kriging, none_floor=a.none_floor, anisotropy=a.anisotropy, dedupe_runs=a.dedupe_runs, lag_spacing=a.lag_spacing, max_lag_m=a.max_lag_m, min_session_rows=a.min_session_rows, support_range_multiple=a.support_range_multiple, cell_m=a.cell_m, variogram_model=a.variogram_model, nlags=a.nlags, folds=a.folds, seed=a.seed, block_m=a.block_m)


def interpolate(spark, a) -> None:
    c, rows = _config(a), spark.read.parquet(a.measurements)
    if a.compare:
        # towards a like-for-like comparison, dead zones have no stand-in value here
        points, _ = runs.points_of(rows, config.replace(c, none_floor=None), a.metric)
        crossval.compare(spark, kriging.cloud(points), {k: v for k, v in c.model().items() if k in ("nlags", "spacing", "max_lag")}, c.folds, scan=True).show(truncate=False)
        return
    run = runs.interpolate(rows, c, a.metric, c.output_dir, on_cv=lambda m: print(f"{m['scheme']}: RMSE {m['rmse']:.2f}, R2 {m['r2'] if m['r2'] is None else round(m['r2'], 2)}, {m['skill']}, {m['calibration']}"))
    print(json.dumps(run.paths))


def suggest(spark, a) -> None:
    from larkspan.sources import roads

    options = {"top_n": a.top_n, "quantile": a.candidate_quantile, "most_road_m": a.max_road_dist_m, "apart_m": a.min_separation_m, "weak_bias": a.weak_bias, "fetch": roads.overpass(a.network_type), "refresh_roads": a.refresh_roads}
    if a.recompute:
        out = runs.suggest_recomputed(spark.read.parquet(a.recompute), config.Config.from_env(output_dir=a.out_dir, kriging=a.kriging), a.cache_dir, a.out_dir, a.metric, **options)
    else:
        out = runs.suggest_from_file(spark, a.stddev_tif or f"{a.out_dir}/{a.metric}_kriging_stddev.tif", a.cache_dir, a.out_dir, a.metric, **options)
    capped = " (more were wanted: targets are ranked against a part of the roads)" if out["tiles_wanted"] > out["tiles_fetched"] else ""
    print(f"Roads of {out['tiles_fetched']} of {out['tiles_wanted']} tiles{capped}; score: " + (f"reduction of variance within {out['range_m']:.0f} m" if out["range_m"] else "deviation"))
    for s in out["suggestions"]:
        print(f"{s['rank']}. ({s['lat']:.5f}, {s['lon']:.5f}) {s['road_name'] or 'unnamed road'}, deviation {s['stddev']:.2f}, stop {s['visit_order']}")


def refresh(spark, a) -> None:
    from larkspan.sources import roads

    done = runs.refresh_all(spark.read.parquet(a.measurements), config.Config.from_env(output_dir=a.out_dir, kriging=a.kriging), a.metric, a.cache_dir, roads.overpass(a.network_type), a.force)
    print("unchanged" if done is None else f"refreshed: surfaces and {done['suggestions']} suggestions ({done['scheme']} RMSE {done['rmse']:.2f})")


def ingest(spark, a) -> None:
    from larkspan.streaming import ingest as stream

    q = stream.start(spark, a.landing, a.table, a.checkpoint, a.rejects, on_counts=lambda c: print(json.dumps(c)), every=a.every)
    q.awaitTermination()


def serve(spark, a) -> None:
    from larkspan.serving import serve as run

    run(a.suggestions, a.port, spark, a.table)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspan")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *args):
        q = sub.add_parser(f.__name__)
        q.set_defaults(run=f)
        for names, kw in args:
            q.add_argument(*names, **kw)

    o = lambda *names, **kw: (names, kw)
    source, filing = o("measurements"), [o("claims"), o("--environment", type=int, choices=(0, 1), default=1), o("--as-of")]
    add(audit, source, *filing, o("--out-dir", default="output"), o("--prefix", default="claims"))
    add(verify, source, *filing, o("--table"), o("--skip-load", action="store_true"), o("--keep", action="store_true"), o("--json"))
    add(publish, source, *filing, o("--out", default="output/hexes.geojson"), o("--min-measurements", type=int, default=3))
    add(stats, source)
    mode, metric, out = o("--kriging", type=config.parse_mode), o("--metric", default="rsrp"), o("--out-dir", default="output")
    add(
        interpolate, source, mode, metric, out, o("--cell-m", type=float), o("--variogram-model", choices=("linear", "power", "gaussian", "spherical", "exponential")), o("--nlags", type=int), o("--min-session-rows", type=int), o("--lag-spacing", type=config.parse_spacing), o("--max-lag-m", type=float),
        o("--support-range-multiple", type=config.parse_multiple), o("--folds", type=int), o("--seed", type=int), o("--block-m", type=float), o("--anisotropy", type=config.parse_anisotropy), o("--none-floor", type=float), o("--dedupe-runs", type=config.parse_bool), o("--compare", action="store_true"),
    )
    net = o("--network-type", choices=("drive", "drive_service", "all"), default="drive")
    add(suggest, o("stddev_tif", nargs="?"), o("--recompute", metavar="MEASUREMENTS"), o("--refresh-roads", action="store_true"), net, mode, metric, out, o("--cache-dir", default="cache"), o("--top-n", type=int, default=10), o("--candidate-quantile", type=float, default=0.70), o("--max-road-dist-m", type=float, default=250.0), o("--min-separation-m", type=float, default=1200.0), o("--weak-bias", type=float, default=0.5))
    add(refresh, source, mode, metric, out, net, o("--cache-dir", default="cache"), o("--force", action="store_true"))
    add(ingest, o("landing"), o("table"), o("checkpoint"), o("--rejects"), o("--every"))
    add(serve, o("suggestions"), o("--port", type=int, default=8080), o("--table"))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = None if a.command == "serve" and not a.table else SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if spark is not None:
            from larkspan.runtime import ship

            ship(spark)
        a.run(spark, a)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
