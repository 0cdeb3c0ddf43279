"""Document rewriting by a schema: drop undeclared keys, coerce types, fill in defaults, in that order, at every level."""

from __future__ import annotations

import re
from copy import deepcopy
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridoc.functions.regex import to_java, to_python
from veridoc.functions.text import fresh, let, quote, spelled
from veridoc.operators.validator import parsed
from veridoc.plans.boolean import as_map, as_text, has, is_type, member
from veridoc.schema.resolve import Place, RecursiveSchema, Resources, TooManyReferences

_EMPTY = "CAST(map() AS MAP<STRING, VARIANT>)"
#: Decimal numbers with or without an exponent, and hexadecimal ones, as texts; blanks around are allowed.
_DECIMAL, _HEX = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*\z", r"^\s*0[xX][0-9a-fA-F]{1,15}\s*\z"


def _number(d: str) -> str:
    """A variant of a double: an integer where it is whole."""
    return f"CASE WHEN {d} % 1 = 0 AND abs({d}) < 9007199254740992D THEN CAST(CAST({d} AS BIGINT) AS VARIANT) ELSE CAST({d} AS VARIANT) END"


def coerced(v: str, target: str) -> str:
    """The variant v as the target type where its value allows it, else unchanged."""
    text = as_text(v)
    if target in ("number", "integer"):
        value = let(
            f"CASE WHEN {text} RLIKE {quote(_DECIMAL)} THEN try_cast(trim({text}) AS DOUBLE) WHEN {text} RLIKE {quote(_HEX)} THEN CAST(conv(substr(trim({text}), 3), 16, 10) AS DOUBLE) END",
            lambda d: f"CASE WHEN {d} IS NULL OR abs({d}) = double('infinity'){f' OR {d} % 1 <> 0' if target == 'integer' else ''} THEN {v} ELSE {_number(d)} END",
        )
        flag = f"CASE WHEN try_variant_get({v}, '$', 'boolean') THEN CAST(1L AS VARIANT) ELSE CAST(0L AS VARIANT) END"
        return f"CASE WHEN {is_type(v, 'string')} THEN {value} WHEN {is_type(v, 'boolean')} THEN {flag} ELSE {v} END"
    if target == "string":
        shown = f"CAST(regexp_replace(to_json({v}), {quote(chr(92) + '.0+' + chr(92) + 'z')}, '') AS VARIANT)"
        return f"CASE WHEN {is_type(v, 'number')} OR {is_type(v, 'boolean')} THEN {shown} ELSE {v} END"
    if target == "boolean":
        return f"CASE WHEN {is_type(v, 'string')} AND {text} IN ('true', '1') THEN CAST(true AS VARIANT) WHEN {is_type(v, 'string')} AND {text} IN ('false', '0') THEN CAST(false AS VARIANT) ELSE {v} END"
    return v


def coerced_value(x: Any, target: str) -> Any:
    """What ``coerced`` does, to a Python value."""
    if target in ("number", "integer") and isinstance(x, bool):
        return int(x)
    if target in ("number", "integer") and isinstance(x, str):
        python = lambda p: p.replace(r"\z", r"\Z")
        number = float(x) if re.search(python(_DECIMAL), x) else float(int(x.strip()[2:], 16)) if re.search(python(_HEX), x) else None
        if number is None or abs(number) == float("inf") or target == "integer" and number % 1:
            return x
        return int(number) if number % 1 == 0 and abs(number) < 2**53 else number
    if target == "string" and isinstance(x, (bool, int, float)):
        return spelled(x)
    if target == "boolean" and isinstance(x, str) and x in ("true", "1", "false", "0"):
        return x in ("true", "1")
    return x


class Rewriter:
    """Rewrites documents; what it doesn't touch stays as it is."""

    def __init__(self, schema: Any, *, schemas=(), coerce_types: bool = False, remove_additional: bool = False, defaults: bool = True):
        self.resources, self.root = Resources.of(schema, schemas)
        self.coerce_types, self.remove_additional, self.defaults = coerce_types, remove_additional, defaults

    def sql(self, v: str) -> str:
        """SQL of the rewritten variant named v."""
        self.resources.followed = 0
        return self._rewrite(self.root, v)

    def _touched(self, place: Place) -> bool:
        return self._rewrite(place, "v") != "v"

    def _rewrite(self, place: Place, v: str) -> str:
        schema = place.schema
        if not isinstance(schema, dict):
            return v
        if "$ref" in schema:
            try:
                place = self.resources.follow(place)
            except TooManyReferences:
                raise
            except RecursiveSchema:
                return v
            return self._rewrite(place, v)
        declared = schema.get("properties", {})
        drop = self.remove_additional and schema.get("additionalProperties") is False
        changed: dict[str, tuple[Any, bool]] = {}
        for k, sub in declared.items():
            fill = self.defaults and isinstance(sub, dict) and "default" in sub
            if fill or self._member(place, sub, "v") != "v":
                changed[k] = (sub, fill)
        if not changed and not drop:
            return v

        def rebuilt(m: str) -> str:
            k, x = fresh("k"), fresh()
            keep = []
            if drop:
                known = [f"{k} IN ({', '.join(map(quote, declared))})"] if declared else []
                known += [f"{k} RLIKE {quote(to_java(p))}" for p in schema.get("patternProperties", {})]
                keep.append("(" + (" OR ".join(known) or "false") + ")")
            if changed:
                keep.append(f"{k} NOT IN ({', '.join(map(quote, changed))})")
            parts = [f"map_filter({m}, ({k}, {x}) -> {' AND '.join(keep)})"]
            for name, (sub, fill) in changed.items():
                inner = let(member(v, m, name), lambda y, sub=sub: self._member(place, sub, y))
                other = f"map({quote(name)}, parse_json({quote(spelled(sub['default']))}))" if fill else _EMPTY
                parts.append(f"CASE WHEN {has(m, name)} THEN map({quote(name)}, {inner}) ELSE {other} END")
            return f"CASE WHEN {m} IS NULL THEN {v} ELSE to_variant_object(map_concat({', '.join(parts)})) END"

        return let(as_map(v), rebuilt)

    def _member(self, place: Place, sub: Any, v: str) -> str:
        """A property's value: coerced to its type, then rewritten inside."""
        if not isinstance(sub, dict):
            return v
        inner = self._rewrite(place.sub(sub, self.resources), v)
        if self.coerce_types and isinstance(sub.get("type"), str) and sub["type"] in ("number", "integer", "string", "boolean"):
            return coerced(v, sub["type"])
        return inner

    def value(self, x: Any, place: Place | None = None) -> Any:
        """The rewritten document as a Python value; follows references however often they lead back."""
        place = place or self.root
        schema = place.schema
        if not isinstance(schema, dict):
            return x
        if "$ref" in schema:
            try:
                return self.value(x, self.resources.follow(place))
            except TooManyReferences:
                raise
            except RecursiveSchema:
                return x
        if not isinstance(x, dict):
            return x
        declared, out = schema.get("properties", {}), dict(x)
        if self.remove_additional and schema.get("additionalProperties") is False:
            patterns = [to_python(p) for p in schema.get("patternProperties", {})]
            out = {k: v for k, v in out.items() if k in declared or any(p.search(k) for p in patterns)}
        for k, sub in declared.items():
            if not isinstance(sub, dict):
                continue
            if k in out:
                scalar = self.coerce_types and isinstance(sub.get("type"), str) and sub["type"] in ("number", "integer", "string", "boolean")
                self.resources.followed = 0
                out[k] = coerced_value(out[k], sub["type"]) if scalar else self.value(out[k], replace(place.sub(sub, self.resources), open_refs=()))
            elif self.defaults and "default" in sub:
                out[k] = deepcopy(sub["default"])
        return out

    def column(self, column: Column | str, kind: str = "json") -> Column:
        """The rewritten document as a variant; null where the text is no JSON document."""
        c = F.col(column) if isinstance(column, str) else column
        read = {"json": parsed, "variant": lambda x: x, "struct": lambda x: f"parse_json(to_json({x}))", "struct_nulls": lambda x: f"to_variant_object({x})"}[kind]
        body = let(read("veridoc_source"), lambda d: f"CASE WHEN {d} IS NULL THEN NULL ELSE {self.sql(d)} END")
        return F.get(F.call_function("transform", F.array(c), F.expr(f"veridoc_source -> {body}")), F.lit(0))


def rewrite(schema: Any, column: Column | str, kind: str = "json", **options: Any) -> Column:
    """The document of a column after removing, coercing and defaulting as the options say."""
    return Rewriter(schema, **options).column(column, kind)


__all__ = ["Rewriter", "coerced", "rewrite"]
