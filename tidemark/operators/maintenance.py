"""What follows a capture run: a copy held against its original, repairs in their order, pruning, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.operators import repair
from tidemark.schemas import Tables
from tidemark.sources.store import Snapshot, Store


def steps(now, since=None, until=None, classify: Callable[[DataFrame], DataFrame] | None = None, releases: Callable[[Tables], DataFrame] | None = None) -> list[tuple[str, Callable[[Tables], Tables]]]:
    """The repairs by name, in order: ads are branded before they fold, songs fold before their cut plays are joined.

    ``releases`` takes tables and returns (song_id, first_release, release_dates) of songs it knows.
    """
    out: list[tuple[str, Callable[[Tables], Tables]]] = [
        ("boundaries", lambda t: repair.fill_brands(t, repair.plan_boundaries(t, since, until))),
        ("backfill", lambda t: repair.backfill_brands(t, repair.plan_backfill(t, since, until, classify=classify), now)),
        ("commercials", lambda t: repair.dedupe_commercials(t, repair.plan_commercial_dedupe(t))),
        ("brands", lambda t: repair.merge_brands(t, repair.plan_brand_merge(t))),
        ("songs", repair.dedupe_songs),
        ("stitch", lambda t: repair.stitch(t, repair.plan_stitch(t, since, until))),
    ]
    if releases is not None:
        out.append(("enrich", lambda t: repair.enrich_releases(t, releases(t), since, until)[0]))
    return out


def run_all(t: Tables, now, since=None, until=None, **models) -> Tables:
    """All repairs on tables in memory."""
    for _, step in steps(now, since, until, **models):
        t = step(t)
    return t


def maintain(store: Store, backup: str, now, since=None, until=None, prune: Callable[[Tables], object] | None = None, report: Callable[[Tables], object] | None = None, keep: int = 8, done: Callable[[str], object] | None = None, **models) -> Snapshot:
    """The whole sequence on a store: backup, repairs, pruning, reports; returns the last version.

    The copy in ``backup`` must agree with the store in rows and digests, else nothing is touched. Each repair
    is committed as a version, read from the one before, so a run that ends in between is a shorter run. ``prune``
    takes recordings away, old versions go as well; ``report`` gets the repaired tables. ``done`` hears the name of
    each step that is over.
    """
    tell = done or (lambda name: None)
    store.copy_to(backup)
    tell("backup")
    last = store.snapshot()
    for name, step in steps(now, since, until, **models):
        last = store.change(step)
        tell(name)
    if prune is not None:
        prune(store.read(last))
    store.prune(keep)
    tell("prune")
    if report is not None:
        report(store.read(last))
        tell("reports")
    return last
