"""References: identifiers, anchors, pointers and the dynamic scope, all resolved on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

from veridoc.schema.normalize import Schema, SchemaError, normalize, subschemas, without_misfits


class RecursiveSchema(SchemaError):
    """A reference leads back to itself, so the schema has no finite expression."""


class TooManyReferences(RecursiveSchema):
    """Written out, the references would make more text than Spark can take."""


#: References that are written out into one expression, at most. Of schemas with more, what several ask of a value is merged;
#: if that follows more than so many, or makes more than so many characters, they go through the interpreter.
MOST_REFERENCES = 400
MOST_MERGED, MOST_TEXT = 5_000, 100_000


@dataclass(frozen=True)
class Place:
    """A schema within its resource: base is the resource's identifier, scope the resources entered, outermost first."""

    schema: Schema
    base: str
    scope: tuple[str, ...] = ()
    open_refs: tuple[int, ...] = ()

    def sub(self, schema: Schema, resources: Resources) -> Place:
        """A subschema, which may start a resource of its own."""
        base = resources.base_of.get(id(schema), self.base)
        return replace(self, schema=schema, base=base, scope=self.scope if base == self.base else (*self.scope, base))


@dataclass
class Resources:
    """All schemas that references can reach."""

    roots: dict[str, Schema] = field(default_factory=dict)
    anchors: dict[tuple[str, str], Schema] = field(default_factory=dict)
    dynamic: dict[tuple[str, str], Schema] = field(default_factory=dict)
    base_of: dict[int, str] = field(default_factory=dict)
    followed: int = 0
    most: int = MOST_REFERENCES
    seen: list[Schema] = field(default_factory=list)

    def __getstate__(self) -> dict[str, Any]:
        return {**self.__dict__, "base_of": [self.base_of[id(s)] for s in self.seen]}

    def __setstate__(self, state: dict[str, Any]) -> None:
        """Identities are those of the copies, in another process."""
        self.__dict__.update(state)
        self.base_of = {id(s): base for s, base in zip(self.seen, state["base_of"])}

    @classmethod
    def of(cls, schema: Schema, others: Iterable[Schema] = ()) -> tuple[Resources, Place]:
        """The resources of a schema and of a registry's schemas, all normalized."""
        out = cls()
        for i, other in enumerate(others):
            other = without_misfits(normalize(other))
            out._enter(other, f"urn:registry:{i}")
        main = without_misfits(normalize(schema))
        base = out._enter(main, "urn:main")
        return out, Place(main, base, (base,))

    def _enter(self, schema: Schema, base: str) -> str:
        own = schema.get("$id") if isinstance(schema, dict) else None
        base = urldefrag(urljoin(base, own) if not base.startswith("urn:") else own)[0] if own else base
        self.roots[base] = schema
        self._walk(schema, base)
        return base

    def _walk(self, schema: Any, base: str) -> None:
        if not isinstance(schema, dict):
            return
        self.base_of[id(schema)] = base
        self.seen.append(schema)
        for key, table in (("$anchor", self.anchors), ("$dynamicAnchor", self.dynamic)):
            if key in schema:
                table[base, schema[key]] = schema
                self.anchors[base, schema[key]] = schema
        for _, sub in subschemas(schema):
            if isinstance(sub, dict) and sub.get("$id", "#").partition("#")[0]:
                self._enter(sub, base)
            else:
                self._walk(sub, base)

    def _point(self, schema: Schema, base: str, pointer: str) -> tuple[Schema, str]:
        at: Any = schema
        for step in pointer.split("/")[1:]:
            step = unquote(step).replace("~1", "/").replace("~0", "~")
            if isinstance(at, list) and step.isdigit() and int(step) < len(at):
                at = at[int(step)]
            elif isinstance(at, dict) and step in at:
                at = at[step]
            elif isinstance(at, dict) and step == "definitions" and "$defs" in at:
                at = at["$defs"]
            else:
                raise SchemaError(f"cannot resolve {pointer}")
            base = self.base_of.get(id(at), base) if isinstance(at, dict) else base
        if not isinstance(at, (dict, bool)):
            raise SchemaError(f"{pointer} is no schema")
        if isinstance(at, dict) and id(at) not in self.base_of:
            self._walk(at, base)
        return at, base

    def _find(self, ref: str, base: str) -> tuple[Schema, str, str]:
        """Target, its base, and the fragment."""
        uri, _, fragment = ref.partition("#")
        if uri:
            joined = urldefrag(urljoin(base, uri))[0] if not base.startswith("urn:") else uri
            known = [x for x in (joined, uri) if x in self.roots] or [x for x in self.roots if x.endswith("/" + uri.lstrip("./"))]
            if not known:
                raise SchemaError(f"cannot resolve {ref}")
            base = known[0]
        root = self.roots[base]
        if not fragment:
            return root, base, fragment
        if fragment.startswith("/"):
            target, base = self._point(root, base, fragment)
            return target, base, fragment
        if (base, fragment) in self.anchors:
            return self.anchors[base, fragment], base, fragment
        others = [x for (_, name), x in self.anchors.items() if name == fragment]
        if others:
            return others[0], self.base_of[id(others[0])], fragment
        raise SchemaError(f"cannot resolve {ref}")

    def follow(self, place: Place, dynamic: bool = False, recursive: bool = False) -> Place:
        """Where the $ref (or $dynamicRef) of a place leads. With recursive, it may lead back to itself."""
        ref = place.schema["$dynamicRef" if dynamic else "$ref"]
        target, base, fragment = self._find(ref if "#" in ref or not dynamic else f"#{ref}", place.base)
        if dynamic and isinstance(target, dict) and target.get("$dynamicAnchor") == fragment:
            for outer in place.scope:
                if (outer, fragment) in self.dynamic:
                    target, base = self.dynamic[outer, fragment], outer
                    break
        if not recursive and id(target) in place.open_refs:
            raise RecursiveSchema(f"{ref} leads back to itself")
        if not recursive:
            self.followed += 1
            if self.followed > self.most:
                raise TooManyReferences(f"over {self.most} references")
        scope = place.scope if base == place.base else (*place.scope, base)
        return Place(target, base, scope if not recursive else scope[:64], place.open_refs if recursive else (*place.open_refs, id(target)))
