"""Command line over a folder of tables: ``python -m tidemark.cli --tables DIR report songs --since 7d``.

Reports print text. Repairs print their plan; with --apply they commit the repaired tables as a new version.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timewin import resolve_window
from tidemark.operators import maintenance, repair, reports
from tidemark.plans import render
from tidemark.schemas import VERSION, Tables
from tidemark.sources.readers import read_tracklist
from tidemark.sources.store import Conflict, Store
from tidemark.sources.writers import append_tracklist


def _top(a: argparse.Namespace, usual: int) -> int:
    """How many rows were asked for; none is a number like others."""
    return usual if a.top is None else a.top


WINDOWED = {
    "commercials": lambda t, w, a: reports.commercials_by_brand(t, **w, top_n=_top(a, 25)) if a.by_brand else reports.commercials_top(t, **w, top_n=_top(a, 10), brand=a.brand),
    "brands": lambda t, w, a: reports.brands_top(t, **w, top_n=_top(a, 25)),
    "songs": lambda t, w, a: reports.songs_top(t, **w, top_n=_top(a, 10), gap=a.gap),
    "songs-added": lambda t, w, a: reports.songs_added(t, **w, source=a.source, top_n=_top(a, 50)),
    "songs-timeline": lambda t, w, a: reports.songs_timeline(t, **w, limit=_top(a, 500)),
    "artists": lambda t, w, a: reports.artists_top(t, **w, top_n=_top(a, 10), gap=a.gap),
    "artist-plays": lambda t, w, a: reports.top_artist_playlogs(t, **w, top_n=_top(a, 3), gap=a.gap),
    "timeline": lambda t, w, a: reports.timeline(t, **w, limit=_top(a, 500)),
    "summary": lambda t, w, a: reports.summary(t, **w),
    "runs": lambda t, w, a: reports.runs_summary(t, top_n=_top(a, 50)),
}


def _merge(t: Tables, p: DataFrame, now) -> Tables:
    return repair.merge_brands(t, p)


#: group, command -> (plan, apply); plans take the tables and the window.
REPAIRS: dict[tuple[str, str], tuple[Callable, Callable]] = {
    ("songs", "dedupe"): (lambda t, w: repair.plan_song_dedupe(t), lambda t, p, now: repair.dedupe_songs(t, p)),
    ("songs", "stitch"): (lambda t, w: repair.plan_stitch(t, **w), lambda t, p, now: repair.stitch(t, p)),
    ("commercials", "dedupe"): (lambda t, w: repair.plan_commercial_dedupe(t), lambda t, p, now: repair.dedupe_commercials(t, p)),
    ("commercials", "backfill-brands"): (lambda t, w: repair.plan_backfill(t, **w), repair.backfill_brands),
    ("commercials", "merge-boundaries"): (lambda t, w: repair.plan_boundaries(t, **w), lambda t, p, now: repair.fill_brands(t, p)),
    ("commercials", "merge-brands"): (lambda t, w: repair.plan_brand_merge(t), _merge),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("--tables", required=True, help="folder of the tables")
    groups = top.add_subparsers(dest="group", required=True)

    def command(group, name: str, *flags: str) -> argparse.ArgumentParser:
        c = group.add_parser(name)
        for f in flags:
            c.add_argument(f)
        return c

    window = ("--since", "--from", "--to")
    report = groups.add_parser("report").add_subparsers(dest="command", required=True)
    for name in (*WINDOWED, "dashboard"):
        c = command(report, name, *window, "--brand", "--source", "--html")
        c.add_argument("--top", type=int)
        c.add_argument("--gap", type=float, default=60.0)
        c.add_argument("--by-brand", action="store_true")
    songs = groups.add_parser("songs").add_subparsers(dest="command", required=True)
    ads = groups.add_parser("commercials").add_subparsers(dest="command", required=True)
    for group, name in REPAIRS:
        command(songs if group == "songs" else ads, name, *window).add_argument("--apply", action="store_true")
    c = command(songs, "discovered", "--since", "--tracklist")
    c.add_argument("--top", type=int, default=50)
    c.add_argument("--min-plays", type=int, default=0)
    c.add_argument("--only-new", action="store_true")
    c = command(songs, "enrich-releases", *window)
    c.add_argument("--found", required=True, help="JSON lines of song_id, first_release, release_dates")
    c.add_argument("--dry-run", action="store_true")
    c = command(songs, "promote", "--tracklist")
    c.add_argument("ids", type=int, nargs="+")
    runs = groups.add_parser("runs").add_subparsers(dest="command", required=True)
    command(runs, "list").add_argument("--top", type=int, default=50)
    command(runs, "start", "--host", "--notes").add_argument("run_id")
    command(runs, "end", "--notes").add_argument("run_id")
    db = groups.add_parser("db").add_subparsers(dest="command", required=True)
    command(db, "init")
    command(db, "migrate")
    command(db, "version")
    command(db, "maintain", *window, "--report").add_argument("--backup", required=True, help="folder of the copy that is checked first")
    return top


def _window(a: argparse.Namespace) -> dict:
    begin, end = resolve_window(a.since, getattr(a, "from"), a.to)
    return {"since": begin, "until": end}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """0 if all went well, 2 if the arguments make no sense, 3 if another writer was first."""
    out, a = out or sys.stdout, parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(UTC)
    try:
        store = Store(spark, a.tables)
        base = store.snapshot()
        if (a.group, a.command) == ("db", "version"):
            print(base.schema if base else VERSION, file=out)
            return 0
        if (a.group, a.command) == ("db", "init"):
            store.commit(Tables.empty(spark), base)
            return 0
        t = store.read(base)
        if a.group == "report":
            w = _window(a)
            if a.command == "dashboard":
                parts = {n: WINDOWED[n](t, w, a) for n in ("summary", "songs", "artists", "commercials", "brands")}
                text = render.dashboard("Broadcast", reports.dashboard_totals(t, **w), parts)
            else:
                df = WINDOWED[a.command](t, w, a)
                text = render.playlog_page("Plays", df) if a.html and a.command == "artist-plays" else render.table(df)
            if a.html:
                with open(a.html, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text, file=out)
        elif (a.group, a.command) in REPAIRS:
            plan, apply = REPAIRS[a.group, a.command]
            found = plan(t, _window(a))
            print(render.table(found.select(*[c if k in ("string", "bigint", "int", "double") else F.col(c).cast("string").alias(c) for c, k in found.dtypes])), file=out)
            if a.apply:
                store.commit(apply(t, found, now), base, t)
        elif (a.group, a.command) == ("songs", "discovered"):
            listed = read_tracklist(spark, a.tracklist) if a.tracklist else None
            since = resolve_window(a.since)[0] if a.since else None
            print(render.table(reports.discoveries(t, listed, since, a.top, a.min_plays, a.only_new)), file=out)
        elif (a.group, a.command) == ("songs", "promote"):
            asked = spark.createDataFrame(list(enumerate(a.ids)), "at int, song_id long")
            rows = repair.plan_promotions(t, asked, read_tracklist(spark, a.tracklist)).orderBy("at").collect()  # as many as were asked for
            append_tracklist(a.tracklist, [(r["artist"], r["title"]) for r in rows if r["reason"] is None], now.date())
            for r in rows:
                print(f"{r['song_id']}: {r['reason'] or 'promoted'}", file=out)
        elif (a.group, a.command) == ("runs", "list"):
            print(render.table(reports.runs_summary(t, a.top)), file=out)
        elif (a.group, a.command) == ("runs", "start"):
            new = spark.createDataFrame([(a.run_id, now, None, str(VERSION), a.host, a.notes, now)], "run_id string, started_utc timestamp, ended_utc timestamp, pipeline_version string, host string, notes string, created_at timestamp")
            store.commit(repair.open_runs(t, new), base, t)
        elif (a.group, a.command) == ("runs", "end"):
            ends = spark.createDataFrame([(a.run_id, now, a.notes)], "run_id string, ended_utc timestamp, notes string")
            store.commit(repair.close_runs(t, ends), base, t)
        elif (a.group, a.command) == ("songs", "enrich-releases"):
            found = spark.read.schema("song_id bigint, first_release string, release_dates array<string>").json(a.found)
            after, told = repair.enrich_releases(t, found, **_window(a))
            print(render.table(told), file=out)
            if not a.dry_run:
                store.commit(after, base, t)
        elif (a.group, a.command) == ("db", "maintain"):
            w = _window(a)

            def report(after: Tables) -> None:
                parts = {n: WINDOWED[n](after, w, argparse.Namespace(top=None, gap=60.0, brand=None, by_brand=False)) for n in ("summary", "songs", "artists", "commercials", "brands")}
                with open(a.report, "w", encoding="utf-8") as f:
                    f.write(render.dashboard("Broadcast", reports.dashboard_totals(after, **w), parts))

            maintenance.maintain(store, a.backup, now, **w, report=report if a.report else None, done=lambda name: print(name, file=out))
        elif base is None:
            store.commit(repair.add_runs(t, now), None)
        else:
            store.migrate(now)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Conflict as e:
        print(f"error: {e}; nothing was changed", file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
