"""Plans that users run: dashboards, serving queries, reports."""
