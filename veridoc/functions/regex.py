"""Regular expressions of the ECMAScript dialect for Java's and Python's engines."""

from __future__ import annotations

import re

from veridoc.schema.normalize import SchemaError

#: The white space of ECMAScript.
_WHITE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _translate(pattern: str, end: str, java: bool) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise SchemaError(f"pattern ends with a backslash: {pattern}")
            two = pattern[i + 1]
            if m := re.match(r"\\u\{([0-9a-fA-F]+)\}", pattern[i:]):
                code = int(m[1], 16)
                out.append(f"\\x{{{code:X}}}" if java else f"\\U{code:08X}")
                i += m.end()
                continue
            if two == "s":
                out.append(_WHITE if inside else f"[{_WHITE}]")
            elif two == "S" and not inside:
                out.append(f"[^{_WHITE}]")
            elif two == "d":
                out.append("0-9" if inside else "[0-9]")
            elif two == "w":
                out.append("A-Za-z0-9_" if inside else "[A-Za-z0-9_]")
            elif two in "DW" and not inside:
                out.append("[^0-9]" if two == "D" else "[^A-Za-z0-9_]")
            elif two == "/":
                out.append("/")
            elif two == "k" and java is False:
                m = re.match(r"\\k<(\w+)>", pattern[i:])
                out.append(f"(?P={m[1]})" if m else "\\k")
                i += m.end() if m else 2
                continue
            else:
                out.append(c + two)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
                out.append(c)
            elif c == "[" or java and c == "&":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 3] == "^]":
                out[-1] = r"[\s\S]"
                inside = False
                i += 3
                continue
            if pattern[i + 1 : i + 2] == "]":
                out[-1] = "(?!)"
                inside = False
                i += 2
                continue
        elif c == "$":
            out.append(end)
        elif not java and pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!"):
            out.append("(?P<")
            i += 3
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    """For RLIKE: the end is the very end, white space is ECMAScript's, a bracket in a class stands for itself."""
    out = _translate(pattern, r"\z", True)
    to_python(pattern)  # tells of what neither engine takes
    return out


def to_python(pattern: str) -> re.Pattern:
    text = _translate(pattern, r"\Z", False)
    if re.search(r"\\[pP]\{", text):
        import regex

        try:
            return regex.compile(text)
        except regex.error as e:
            raise SchemaError(f"pattern {pattern}: {e}") from None
    try:
        return re.compile(text)
    except re.error as e:
        raise SchemaError(f"pattern {pattern}: {e}") from None
