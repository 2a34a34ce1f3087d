"""The reports and their rendering in one place, for programs that use them without the command line."""

from tidemark.functions.timewin import parse_since, resolve_window
from tidemark.operators.reports import (
    artists_top,
    brands_top,
    captured_seconds,
    commercials_by_brand,
    commercials_top,
    dashboard_totals,
    discoveries,
    event_at,
    hourly_mix,
    recall,
    runs_summary,
    song_age_stats,
    songs_added,
    songs_timeline,
    songs_top,
    summary,
    timeline,
    top_artist_playlogs,
)
from tidemark.plans.render import dashboard, playlog_page, section, table

__all__ = [
    "artists_top", "brands_top", "captured_seconds", "commercials_by_brand", "commercials_top", "dashboard_totals", "discoveries", "dashboard", "event_at", "hourly_mix",
    "parse_since", "playlog_page", "recall", "resolve_window", "runs_summary", "section", "song_age_stats", "songs_added", "songs_timeline", "songs_top", "summary", "table",
    "timeline", "top_artist_playlogs",
]
