"""Errors of the engine.  Every failure that a caller can cause has a type of its own."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; code is the category that a service would answer with."""

    label = "internal error"
    code = 3

    def __str__(self) -> str:
        return f"{self.label}: {self.args[0] if self.args else ''}"


class InternalError(EngineError):
    code = 5


class InvalidArgument(EngineError):
    label = "invalid argument"


class NotFound(EngineError):
    label = "not found"


class AlreadyExists(EngineError):
    label = "already exists"


class Unsupported(EngineError):
    label = "unsupported"


class StorageError(EngineError):
    label = "storage error"


class Corruption(EngineError):
    label = "corruption"


class AuthError(EngineError):
    label = "authorization error"
    code = 6


class PermissionDenied(EngineError):
    label = "permission denied"
    code = 7


class InvalidState(EngineError):
    label = "invalid state"


class Timeout(EngineError):
    label = "operation timed out"


class QueryIoError(EngineError):
    label = "io error"


class SyntaxProblem(EngineError):
    """A query text that cannot be read; span is a range of UTF-8 bytes."""

    code = 2

    def __init__(self, message: str, span: tuple[int, int]):
        super().__init__(message)
        self.message, self.span = message, span

    def __str__(self) -> str:
        return f"{self.label}: {self.message} at {self.span[0]}..{self.span[1]}"


class LexicalError(SyntaxProblem):
    """kind is one of: unexpected-character, unterminated-string, invalid-escape, control-character,
    invalid-number, unterminated-comment."""

    label = "lexical error"

    def __init__(self, kind: str, span: tuple[int, int], detail: str = ""):
        super().__init__(f"{kind} {detail}".strip(), span)
        self.kind = kind


class ParseError(SyntaxProblem):
    label = "parse error"
