"""All SQL checks by query name."""

from __future__ import annotations

from veilgrid.plans import sql_audit, sql_elements, sql_sessions, sql_sources, sql_text


def all_sql() -> dict[str, str]:
    return (
        sql_text.text_queries() | sql_elements.element_queries() | sql_sessions.session_queries()
        | sql_audit.audit_queries() | sql_sources.source_queries()
    )
