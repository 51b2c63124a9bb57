"""Requests as plans: the engine's calls, result shapes, dashboards."""
