"""Which direct calls mean something local: a parameter or a declaration of an inner block (part of J07).

``local_calls`` works on the balanced tokens of one file, inside the lexer's pass: brackets give the scopes, the innermost one that binds a name
decides. A name that no inner scope binds is left to the file's declarations and imports.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# --- Fixed values: words around parameter lists and declarations ------------------------------
CONTROL = frozenset("if for while switch with return typeof await new super import void delete throw case do else yield in of instanceof".split())
MODIFIERS = frozenset("public private protected readonly override ...".split())
DECLARED = frozenset("const let var".split())
# --- End of fixed values ---------------------------------------------------------------------

# Travels with the lexer that calls it (see there).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CLOSE = {"(": ")", "[": "]", "{": "}", "${": "\ue07d"}
_CLOSING = frozenset(_CLOSE.values())
# Tokens that can open a scope or bind a name.
_BINDING = frozenset(["{", "}", "(", "=>", "function", "class", *DECLARED])


def _is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


def partners(tokens: list[str]) -> dict[int, int]:
    """Place of the closing bracket of each opening one."""
    open_, out = [], {}
    for k, t in enumerate(tokens):
        if t in _CLOSE:
            open_.append(k)
        elif t in _CLOSING and open_:
            out[open_.pop()] = k
    return out


def bound_names(tokens: list[str], a: int, b: int, close: dict[int, int]) -> list[str]:
    """Names that a list of parameters or a destructuring pattern in ``tokens[a:b]`` binds; defaults and types bind none."""
    names: list[str] = []
    k, wanted = a, True
    while k < b:
        t = tokens[k]
        if t == ",":
            wanted = True
        elif t in _CLOSE:
            if wanted and t in ("{", "["):
                names += bound_names(tokens, k + 1, close.get(k, b), close)
            wanted, k = False, close.get(k, b)
        elif wanted and _is_name(t) and t not in MODIFIERS:
            if k + 1 < b and tokens[k + 1] == ":" and (tokens[k + 2:k + 3] in (["{"], ["["]) or a > 0 and tokens[a - 1] == "{"):
                k += 1  # "key: name" of a pattern
            else:
                names.append(t)
                wanted = False
        elif t not in MODIFIERS and t != "@":
            wanted = False
        k += 1
    return names


def _body(tokens: list[str], at: int, close: dict[int, int], arrow: bool) -> tuple[int, int] | None:
    """Range of the body that begins at ``at``: a block, or an expression behind ``=>``."""
    if at < len(tokens) and tokens[at] == "{":
        return at, close.get(at, len(tokens))
    if not arrow:
        return None
    k = at
    while k < len(tokens) and tokens[k] not in (",", ";") and tokens[k] not in _CLOSE.values():
        k = close.get(k, len(tokens)) + 1 if tokens[k] in _CLOSE else k + 1
    return at, k


def _behind_type(tokens: list[str], at: int, close: dict[int, int]) -> int | None:
    """Place of ``{`` or ``=>`` behind the return type that ``:`` at ``at`` begins."""
    k = at + 1
    if tokens[k:k + 1] == ["{"]:
        k = close.get(k, len(tokens)) + 1
    while k < len(tokens) and tokens[k] not in ("{", "=>", ";", ",", "=", "?", ":") and tokens[k] not in _CLOSE.values():
        k = close.get(k, len(tokens)) + 1 if tokens[k] in _CLOSE else k + 1
    return k if k < len(tokens) and tokens[k] in ("{", "=>") else None


def local_calls(tokens: list[str]) -> set[int]:
    """Places of the ``(`` of direct calls whose name an inner scope binds."""
    called = {k for k, t in enumerate(tokens) if t == "(" and k and tokens[k - 1] and _is_name(tokens[k - 1]) and tokens[k - 1] not in CONTROL and (k < 2 or tokens[k - 2] not in (".", "?.", "function"))}
    if not called:
        return set()
    close = partners(tokens)
    scopes: dict[str, list[tuple[int, int]]] = {}
    blocks: list[int] = []
    for k, t in enumerate(tokens):
        if t not in _BINDING:
            continue
        body, names = None, []
        if t == "{":
            blocks.append(k)
        elif t == "}" and blocks:
            blocks.pop()
        elif t == "(" and k in close:
            end, before = close[k] + 1, tokens[k - 1] if k else ""
            if end < len(tokens) and tokens[end] == ":" and before not in CONTROL:
                end = _behind_type(tokens, end, close) or end
            after = tokens[end] if end < len(tokens) else ""
            if after == "=>":
                body = _body(tokens, end + 1, close, True)
            elif after == "{" and before not in CONTROL and (before in ("function", "catch", "*") or before and (_is_name(before) or before == "]")):
                body = _body(tokens, end, close, False)
            if body:
                names = bound_names(tokens, k + 1, close[k], close)
        elif t == "=>" and k and _is_name(tokens[k - 1]) and (k < 2 or tokens[k - 2] != ":"):
            body, names = _body(tokens, k + 1, close, True), [tokens[k - 1]]
        elif blocks and k + 1 < len(tokens) and (k == 0 or tokens[k - 1] != "."):
            if t in DECLARED:
                nxt = tokens[k + 1]
                names = bound_names(tokens, k + 2, close.get(k + 1, k + 2), close) if nxt in ("{", "[") else [nxt] if nxt and _is_name(nxt) else []
            elif t in ("function", "class") and tokens[k + 1] and _is_name(tokens[k + 1]):
                names = [tokens[k + 1]]
            body = (blocks[-1], close.get(blocks[-1], len(tokens)))
        for name in names if body else ():
            scopes.setdefault(name, []).append(body)
    return {k for k in called if any(a <= k < b for a, b in scopes.get(tokens[k - 1], ()))}
