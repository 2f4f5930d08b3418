"""Which columns a Python function's results depend on, found by calling it with values that record what is read.

That tells the truth only of functions that run the same way for all rows.  So a function is
looked through first: one that branches, tests identity or type, catches exceptions or calls
what can't be looked through is refused, and its caller takes all columns for read.
"""

from __future__ import annotations

import dis
import operator
import types
from collections.abc import Callable

from ..errors import Untrackable

#: Instructions that make a function's way, or its result, depend on a value without reading it openly.
_TELLING = ("POP_JUMP", "IS_OP", "PUSH_EXC_INFO", "CHECK_EXC", "BEFORE_WITH", "MATCH_", "SEND", "YIELD", "IMPORT", "STORE_GLOBAL", "STORE_ATTR", "STORE_SUBSCR", "DELETE_", "TO_BOOL", "RAISE_")
_CONSTANTS = (int, float, str, bytes, bool, type(None))


class Read:
    """A value that stands for some columns; what is computed from it stands for them, too."""

    def __init__(self, columns: frozenset[int]):
        self.columns = columns

    def _refuse(self, *_):
        raise Untrackable("the function looks into a value")

    __bool__ = __int__ = __float__ = __len__ = __iter__ = __index__ = __hash__ = __str__ = __format__ = __contains__ = __repr__ = _refuse

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *args, **named: Read(columns_of([self, *args, *named.values()]))


def columns_of(x) -> frozenset[int]:
    if isinstance(x, Read):
        return x.columns
    if isinstance(x, (list, tuple, set)):
        return frozenset().union(*map(columns_of, x)) if x else frozenset()
    if isinstance(x, dict):
        return columns_of([*x.keys(), *x.values()])
    if isinstance(x, _CONSTANTS):
        return frozenset()
    raise Untrackable(f"the function returns a {type(x).__name__}")


def _operator(name: str):
    return lambda self, *others: Read(columns_of([self, *others]))


_KEPT = "__all__ __builtins__ __cached__ __doc__ __file__ __loader__ __name__ __package__ __spec__ __contains__ __index__ __is__ __is_not__ __not__".split()
for _name in dir(operator):
    if _name.startswith("__") and _name.endswith("__") and _name not in _KEPT:
        setattr(Read, _name, _operator(_name))
        setattr(Read, f"__r{_name[2:]}", _operator(_name))


class Row:
    """A row of recording values."""

    def __init__(self, names: list[str]):
        self._names = names

    def __getitem__(self, at):
        if isinstance(at, slice):
            return tuple(Read(frozenset([k])) for k in range(len(self._names))[at])
        return Read(frozenset([self._names.index(at) if isinstance(at, str) else range(len(self._names))[at]]))

    def __getattr__(self, name):
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return self[name]

    def __iter__(self):
        return iter(self[:])

    def __len__(self):
        return len(self._names)


def _pure(*args):
    return Read(columns_of(list(args)))


#: Functions of their arguments alone, which would look into values: called with values that record, they record.
_PURE = {"max": max, "min": min, "abs": abs, "round": round, "len": len}


def recording(f: Callable, depth: int = 3) -> Callable:
    """`f` for a call with recording values; raises Untrackable for one that they can't tell the truth of."""
    if not isinstance(f, types.FunctionType) or not depth or f.__kwdefaults__:
        raise Untrackable(f"{f!r} can't be looked through")
    code = f.__code__
    if code.co_flags & (0x20 | 0x80 | 0x200) or any(isinstance(x, types.CodeType) for x in code.co_consts):
        raise Untrackable("the function makes functions or generators")
    used = dict(zip(code.co_freevars, (c.cell_contents for c in f.__closure__ or ()), strict=True))
    known = {}
    for op in dis.get_instructions(code):
        if op.opname.startswith(_TELLING):
            raise Untrackable(f"the function has {op.opname}")
        if op.opname in ("LOAD_ATTR", "LOAD_METHOD") and str(op.argval).startswith("__"):
            raise Untrackable(f"the function reads {op.argval}")
        if op.opname in ("LOAD_GLOBAL", "LOAD_NAME"):
            if op.argval in f.__globals__:
                used[op.argval] = f.__globals__[op.argval]
            elif op.argval not in _PURE:
                raise Untrackable(f"the function calls {op.argval}")
            else:
                known[op.argval] = _pure
    closure = []
    for name, x in used.items():
        own = x
        if any(x is pure for pure in _PURE.values()):
            own = _pure
        elif isinstance(x, types.FunctionType):
            own = recording(x, depth - 1)
        elif not isinstance(x, _CONSTANTS):
            raise Untrackable(f"the function uses {name}")
        if name in code.co_freevars:
            closure.append(types.CellType(own))
        else:
            known[name] = own
    if not all(isinstance(x, _CONSTANTS) for x in f.__defaults__ or ()):
        raise Untrackable("the function has defaults that aren't constants")
    return types.FunctionType(code, {"__builtins__": {}} | known, f.__name__, f.__defaults__, tuple(closure) or None)


#: What a function may do with a recording value that it wasn't made for; the real call shows errors of its own.
REFUSALS = (Untrackable, TypeError, AttributeError, ValueError, LookupError, ArithmeticError)
