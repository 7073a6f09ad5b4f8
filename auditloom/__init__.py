"""auditloom: a PySpark-native web-page audit engine.

Fetched responses become page facts, facts become issues, issues become scores, and scores, links and duplicates roll
up to reports and exports. Everything is a DataFrame transformation; nothing here starts a job by itself unless it says so.
"""
