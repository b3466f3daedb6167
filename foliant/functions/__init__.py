"""Expression and accumulator compilers."""

from foliant.functions.expressions import Scope, compile_expression

__all__ = ["Scope", "compile_expression"]
