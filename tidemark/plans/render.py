"""Text and HTML of small collected results."""

from __future__ import annotations

import html
import itertools
from datetime import datetime

from pyspark.sql import DataFrame

from tidemark.functions.timewin import format_seconds


def table(df: DataFrame, limit: int = 500, widths: dict[str, int] | None = None) -> str:
    """Fixed-width text: numbers to the right, long cells cut."""
    rows = df.limit(limit).collect()
    names = df.columns
    shown = [["" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    size = [min((widths or {}).get(n, 48), max([len(n), *(len(r[i]) for r in shown)])) for i, n in enumerate(names)]
    right = [kind in ("int", "bigint", "double", "float") for _, kind in df.dtypes]

    def line(cells: list[str]) -> str:
        cut = [c if len(c) <= w else c[: w - 1] + "…" for c, w in zip(cells, size, strict=True)]
        return "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cut, size, right, strict=True)).rstrip()

    return "\n".join([line(names), "  ".join("-" * w for w in size), *map(line, shown)])


def bar(share: float, least: float = 2.0) -> float:
    """A bar's width in percent: visible if there is anything."""
    return 0.0 if share <= 0 else min(100.0, max(least, 100 * share))


def section(title: str, df: DataFrame, limit: int = 50) -> str:
    rows = df.limit(limit).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


def dashboard(title: str, totals: DataFrame, sections: dict[str, DataFrame]) -> str:
    """A page with the totals as bars and one table a section."""
    t = totals.first().asDict()
    bars = "".join(f'<div class="bar" style="width:{bar(t[k]):.0f}%">{html.escape(k)} {100 * t[k]:.1f}%</div>' for k in t if k.endswith("_share"))
    facts = ", ".join(f"{k}: {v}" for k, v in t.items() if not k.endswith("_share"))
    parts = "".join(section(name, df) for name, df in sections.items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{html.escape(facts)}</p>{bars}{parts}</body></html>'


def spin_cell(full: int, promo: int) -> str:
    """Full plays, and short ones in brackets if there are any."""
    return f"{full} (+{promo})" if promo > 0 else f"{full}"


def promo_cell(count: int, length: str) -> str:
    return "-" if count <= 0 else f"{count} / {length}"


def promo_label(label: str, only_promo: bool) -> str:
    return label + " [promo]" * only_promo


def artist_title(artist: str | None, title: str | None) -> str:
    return " - ".join(x for x in (artist, title) if x) or "-"


def shown_time(t: datetime | None) -> str:
    return "" if t is None else t.strftime("%Y-%m-%d %H:%M:%S")


def playlog_page(title: str, plays: DataFrame, limit: int = 5_000) -> str:
    """A page of the top artists' plays (top_artist_playlogs): a section for each artist, a row for each play."""
    rows = plays.limit(limit).select("rank", "artist", "title", "play_start", "is_promo", format_seconds(plays["play_seconds"]).alias("length")).collect()
    out = []
    for _, found in itertools.groupby(sorted(rows, key=lambda r: (r["rank"], r["play_start"])), key=lambda r: r["rank"]):
        log = list(found)
        body = "".join(f"<tr><td>{shown_time(r['play_start'])}</td><td>{html.escape(promo_label(r['title'] or 'Unknown title', r['is_promo']))}</td><td>{r['length']}</td></tr>" for r in log)
        titles = len({r["title"] for r in log})
        out.append(f"<section><h2>{html.escape(log[0]['artist'] or '-')}</h2><p>{len(log)} plays, {titles} titles</p><table><thead><tr><th>when (UTC)</th><th>title</th><th>length</th></tr></thead><tbody>{body}</tbody></table></section>")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{"".join(out)}</body></html>'
