"""Errors with a code, an exit status, an HTTP status and details."""

from __future__ import annotations


class LoreError(Exception):
    code, exit_status, http_status = "internal", 99, 500

    def __init__(self, message: str = "", details: dict[str, object] | None = None):
        super().__init__(message)
        self.details = dict(details or {}) | {"error_code": self.code}


class ValidationError(LoreError):
    code, exit_status, http_status = "validation", 1, 400


class ConflictError(LoreError):
    code, exit_status, http_status = "conflict", 2, 409


class NotFoundError(LoreError):
    code, exit_status, http_status = "not_found", 3, 404


class StorageError(LoreError):
    code, exit_status, http_status = "storage", 4, 500


class BodyTooShort(ValidationError):
    code = "body_length_below_min"


class BodyTooLong(ValidationError):
    code = "body_length_above_max"


class BodyNotText(ValidationError):
    code = "body_invalid_utf8"
