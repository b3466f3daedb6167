"""Errors of compilation and of data changes."""


class CompileError(ValueError):
    """A pipeline, filter, expression or update that has no meaning here."""


class UnsupportedOperator(CompileError):
    """An operator or stage name that is not known."""


class DocumentError(RuntimeError):
    """A failed data change: code, name and message."""

    def __init__(self, code: int, name: str, message: str):
        super().__init__(f"{name}: {message} (code {code})")
        self.code, self.name, self.message = code, name, message
