"""Timetide: a data-quality and timetable-analysis engine on PySpark."""
