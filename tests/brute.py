"""Brute-force nodes of one text with Python's json, for comparison only."""

from __future__ import annotations

import json

# What ECMAScript's trim removes.
JS_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strict(text):
    """(ok, value)"""

    def refuse(word):
        raise ValueError(word)

    try:
        return True, json.loads(text.strip(" \t\n\r"), parse_constant=refuse)
    except ValueError:
        return False, None


def js_items(obj):
    index = [k for k in obj if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1]
    rest = [k for k in obj if k not in set(index)]
    return [(k, obj[k]) for k in sorted(index, key=int) + rest]


def path_text(path):
    return "$" + "".join(f"[{s}]" if s.isascii() and s.isdigit() else f".{s}" for s in path[1:])


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    names = {type(None): "null", str: "string", list: "array", dict: "object"}
    return names.get(type(v), "number")


def walk(value, max_depth=10, path=("$",), ord_=(), chain=()):
    """Rows (ord, path_text, kind, raw_string, chain) in reading order."""
    depth, raw = len(path) - 1, None
    if isinstance(value, str) and depth <= max_depth:
        ok, inner = strict(value.strip(JS_SPACE))
        if ok:
            value, raw = inner, value
    if raw is not None:
        chain = (*chain, path_text(path))
    rows = [(ord_, path_text(path), kind(value), raw, chain)]
    if isinstance(value, dict):
        children = js_items(value)
    elif isinstance(value, list):
        children = [(str(i), v) for i, v in enumerate(value)]
    else:
        children = []
    for i, (key, child) in enumerate(children):
        rows += walk(child, max_depth, (*path, key), (*ord_, i), chain)
    return rows


def rebuilt(value, max_depth=10, depth=0):
    """The value with all strings opened."""
    if isinstance(value, str) and depth <= max_depth:
        ok, inner = strict(value.strip(JS_SPACE))
        if ok:
            value = inner
    if isinstance(value, dict):
        return {k: rebuilt(v, max_depth, depth + 1) for k, v in js_items(value)}
    if isinstance(value, list):
        return [rebuilt(v, max_depth, depth + 1) for v in value]
    return value
