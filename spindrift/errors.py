"""Errors of the public functions, with codes that callers can rely on. What concerns one row of a table is a row with the same code."""

from __future__ import annotations


class SearchError(Exception):
    #: Fixed values, here and below: the codes.
    code = "domain_error"


class ValidationError(SearchError):
    code = "validation_error"


class DocumentNotFound(SearchError):
    code = "document_not_found"


class EndpointNotFound(SearchError):
    code = "endpoint_not_found"


class DuplicateDocument(SearchError):
    code = "duplicate_document"


class ParserError(SearchError):
    code = "parser_error"


class Conflict(SearchError):
    """Another writer was first."""

    code = "refresh_in_progress"


class IntegrationError(SearchError):
    """A source that can't be read."""

    code = "integration_error"


class NotConfigured(IntegrationError):
    """No source, or not this one, is mapped and has credentials."""


def payload(error: Exception) -> dict:
    """What a caller is shown of an error: that it is one, its code and message."""
    return {"error": True, "code": getattr(error, "code", SearchError.code), "message": str(error)}


def checked_top_k(top_k: int) -> int:
    if not 1 <= top_k <= 50:
        raise ValidationError("top_k must be from 1 to 50")
    return top_k


def checked_project(project: str | None) -> str | None:
    if project is None:
        return None
    name = project.strip()
    if not name or len(name) > 128:
        raise ValidationError("project must have 1 to 128 characters")
    return name


def checked_source(source: str | None) -> str | None:
    if source not in (None, "drive", "notion"):
        raise ValidationError("source must be drive or notion")
    return source
