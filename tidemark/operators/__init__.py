"""DataFrame operators: sessions, reports, entity resolution, repairs, reducer, funnel."""
