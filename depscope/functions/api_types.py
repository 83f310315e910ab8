"""Texts for the types, bounds and signatures of an API document's items. A helper for one item; Spark deals them out."""

from __future__ import annotations

import json
from typing import Any

Node = Any


def tagged(node: Node) -> tuple[str, Node]:
    """(tag, content) of a variant, in the forms that documents have had: "tag", {"tag": content}, {"kind": tag, "inner": content}."""
    if isinstance(node, str):
        return node, None
    if isinstance(node, dict) and isinstance(node.get("kind"), str) and "inner" in node:
        return node["kind"], node["inner"]
    if isinstance(node, dict) and len(node) == 1:
        return next(iter(node.items()))
    return "", None


def pick(node: Node, *names: str, default: Node = None) -> Node:
    """The first of these fields that is there: newer names first."""
    return next((node[n] for n in names if isinstance(node, dict) and node.get(n) is not None), default)


def path_text(path: Node) -> str:
    return pick(path, "path", "name", default="") + _arguments(pick(path, "args"))


def last_part(path: Node) -> str:
    return pick(path, "path", "name", default="").rpartition("::")[2]


def _list(parts: list[str], opening: str = "<", closing: str = ">") -> str:
    return f"{opening}{', '.join(parts)}{closing}" if parts else ""


def _arguments(args: Node) -> str:
    tag, held = tagged(args) if args is not None else ("", None)
    if tag == "parenthesized":
        return f"({', '.join(map(type_text, held['inputs']))})" + (f" -> {type_text(held['output'])}" if held.get("output") is not None else "")
    if tag == "return_type_notation":
        return "(..)"
    if tag != "angle_bracketed":
        return ""
    shown = []
    for arg in held["args"]:
        kind, value = tagged(arg)
        shown.append({"lifetime": lambda v: v, "type": type_text, "const": lambda v: v["expr"], "infer": lambda _: "_"}[kind](value))
    return _list(shown + [f"{c['name']} = ..." for c in pick(held, "constraints", "bindings", default=[])])


def bound_text(bound: Node) -> str:
    tag, held = tagged(bound)
    if tag == "trait_bound":
        return {"maybe": "?", "maybe_const": "~const "}.get(held.get("modifier"), "") + path_text(held["trait"])
    return held if tag == "outlives" else "use<...>"


def bounds_text(bounds: list[Node]) -> str:
    return " + ".join(map(bound_text, bounds))


def call_text(sig: Node) -> str:
    shown = f"({', '.join(f'{n}: {type_text(t)}' for n, t in sig['inputs'])})"
    return shown + (f" -> {type_text(sig['output'])}" if sig.get("output") is not None else "")


def _reference(held: Node) -> str:
    life = f"{held['lifetime']} " if held.get("lifetime") else ""
    return f"&{life}{'mut ' if pick(held, 'is_mutable', 'mutable') else ''}{type_text(held['type'])}"


def _qualified(held: Node) -> str:
    own = type_text(held["self_type"])
    return f"<{own} as {path_text(held['trait'])}>::{held['name']}" if held.get("trait") else f"{own}::{held['name']}"


def _dynamic(held: Node) -> str:
    return "dyn " + " + ".join([path_text(t["trait"]) for t in held["traits"]] + ([held["lifetime"]] if held.get("lifetime") else []))


_TYPES = {
    "resolved_path": path_text, "generic": str, "primitive": str, "borrowed_ref": _reference, "tuple": lambda h: f"({', '.join(map(type_text, h))})", "slice": lambda h: f"[{type_text(h)}]", "array": lambda h: f"[{type_text(h['type'])}; {h['len']}]",
    "raw_pointer": lambda h: f"*{'mut' if pick(h, 'is_mutable', 'mutable') else 'const'} {type_text(h['type'])}", "impl_trait": lambda h: f"impl {bounds_text(h)}", "dyn_trait": _dynamic, "function_pointer": lambda h: "fn" + call_text(pick(h, "sig", "decl")),
    "qualified_path": _qualified, "infer": lambda _: "_", "pat": lambda h: type_text(h["type"]),
}


def type_text(node: Node) -> str:
    tag, held = tagged(node)
    return _TYPES[tag](held) if tag in _TYPES else ""


def type_name(node: Node) -> str:
    """The name that a type is looked up by: the last part of its path, references aside."""
    tag, held = tagged(node)
    if tag == "resolved_path":
        return last_part(held)
    if tag == "borrowed_ref":
        return type_name(held["type"])
    return "(tuple)" if tag == "tuple" else f"[{type_name(held)}]" if tag == "slice" else type_text(node)


def parameter_text(param: Node, hidden: bool = False) -> str | None:
    """A generic parameter; None for one that stands for an argument of unnamed type, unless hidden ones are asked for."""
    kind, held = tagged(param["kind"])
    name = param["name"]
    if kind == "lifetime":
        return f"{name}: {' + '.join(held['outlives'])}" if held.get("outlives") else name
    if kind == "const":
        return f"const {name}: {type_text(held['type'])}" + (f" = {held['default']}" if held.get("default") is not None else "")
    if pick(held, "is_synthetic", "synthetic") and not hidden:
        return None
    return name + (f": {bounds_text(held['bounds'])}" if held.get("bounds") else "") + (f" = {type_text(held['default'])}" if held.get("default") is not None else "")


def condition_text(predicate: Node) -> str:
    tag, held = tagged(predicate)
    if tag == "bound_predicate":
        return f"{type_text(held['type'])}: {bounds_text(held['bounds'])}"
    if tag in ("lifetime_predicate", "region_predicate"):
        return held["lifetime"] + (f": {' + '.join(held['outlives'])}" if held.get("outlives") else "")
    kind, value = tagged(held["rhs"])
    return f"{type_text(held['lhs'])} = {value['expr'] if kind == 'constant' else type_text(value)}"


#: Kinds whose names have changed, and the words that begin a signature: fixed values.
NAMES = {"import": "use", "typedef": "type_alias", "type_def": "type_alias", "foreign_type": "extern_type"}
_LEADS = {"function": "fn", "struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "type_alias": "type"}
_FLAGS = {"is_auto": ("is_auto",), "is_unsafe": ("is_unsafe", "unsafe"), "is_dyn_compatible": ("is_dyn_compatible", "is_object_safe"), "is_const": ("is_const", "const"), "is_async": ("is_async", "async"), "has_body": ("has_body",), "is_synthetic": ("is_synthetic", "synthetic"), "is_negative": ("is_negative", "negative")}


def _ids(values: list | None) -> list[str | None]:
    return [None if v is None else str(v) for v in values or []]


def part(kind: str | None, inner: str | None) -> tuple[str, Node] | None:
    """(kind, own part) of an item by its fields `kind`, which older formats have, and `inner`; None if it has no kind."""
    try:
        held = None if inner is None else json.loads(inner)
    except ValueError:  # a text that stands for the whole part
        held = inner
    if kind is not None:
        return kind, held
    return next(iter(held.items())) if isinstance(held, dict) and held else None


def described(kind: str, name: str | None, held: Node) -> dict:
    """What a row needs to know of an item's own part of the document."""
    kind = NAMES.get(kind, kind)
    out: dict = {"kind": kind}
    if kind == "struct_field":
        return out | {"shown": type_text(held)}
    if not isinstance(held, dict):
        return out
    general = held.get("generics") or {}
    params = [p for p in map(parameter_text, general.get("params", [])) if p is not None]
    out["generics"] = [parameter_text(p, True) for p in general.get("params", [])]
    out["conditions"] = [condition_text(p) for p in general.get("where_predicates", [])]
    own = pick(held, "type", "default") if kind != "assoc_const" else held.get("type")
    out["shown"] = type_text(own) if own is not None and not isinstance(own, str) or own == "infer" else None
    sig = pick(held, "sig", "decl")
    if kind in _LEADS:
        out["signature"] = f"{_LEADS[kind]} {name or '_'}{_list(params)}" + (call_text(sig) if sig else "") + (f" = {out['shown']}" if kind == "type_alias" else "")
    elif kind in ("constant", "assoc_const"):
        out["signature"] = f"const {name or '_'}: {out['shown']}"
    elif kind == "static":
        out["signature"] = f"static {'mut ' if pick(held, 'is_mutable', 'mutable') else ''}{name or '_'}: {out['shown']}"
    if sig:
        out["parameters"] = [{"name": n, "type": type_text(t)} for n, t in sig["inputs"]]
        out["returns"] = type_text(sig["output"]) if sig.get("output") is not None else None
    if kind == "impl":
        out |= {"shown": type_text(held["for"]), "type_name": type_name(held["for"]), "blanket": type_text(held["blanket_impl"]) if held.get("blanket_impl") else None}
        if held.get("trait"):
            out |= {"trait": path_text(held["trait"]), "trait_name": last_part(held["trait"])}
    if "bounds" in held:
        out["supers"] = [bound_text(b) for b in held["bounds"]]
    form, parts = tagged(held["kind"]) if held.get("kind") is not None else ("", None)
    members = parts.get("fields") if isinstance(parts, dict) else parts if isinstance(parts, list) else pick(held, "fields", "variants", "items")
    flags = {**(held.get("header") or {}), **held}
    value = held.get("discriminant") or held.get("value") or (held.get("default") if kind == "assoc_const" else None)
    out |= {"form": form or None, "members": _ids(members), "impls": _ids(held.get("impls")), "value": value.get("expr") if isinstance(value, dict) else value, "flags": [f for f, names in _FLAGS.items() if pick(flags, *names)]}
    if kind == "use":
        out |= {"target": None if held.get("id") is None else str(held["id"]), "alias": held.get("name"), "is_glob": bool(pick(held, "is_glob", "glob"))}
    return out
