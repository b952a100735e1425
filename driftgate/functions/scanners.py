"""Linear scans of one text for what regular expressions cannot follow: nesting of any depth.

Plain functions of one string, called for each file or JSON line inside Spark tasks (see
``operators.discovery`` and ``sources.lockio``). Each reads its text once, with a stack.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

# Tasks get these functions by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------------------- JavaScript
_JS_TOKEN = re.compile(r"""
    (?P<comment> //[^\n]* | /\*.*?(?:\*/|\Z) | (?m:^)[ \t]*\*(?!/)[^\n]* )
  | (?P<string> "(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*' )
  | (?P<name> [A-Za-z_$][\w$]* ) | (?P<number> \d[\w.]* )
  | (?P<arrow> => ) | (?P<chain> \?\. (?!\d) ) | (?P<punct> [^\s\w] )
""", re.X | re.S)
_JS_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_JS_PLAIN = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JS_IMPORT = re.compile(r"(?m)^[ \t]*import\s+([^\"';]+?)\s+from\s+[\"']([^\"']+)[\"']")
_JS_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
_JS_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
#: Words before a parenthesis that make it no call, and before a slash that make it a pattern.
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "with", "await", "in", "of", "case", "new", "void", "delete", "yield"}


def js_text(literal: str) -> str:
    """The value of a string literal."""
    def one(m):
        code = m[1] or m[2] or m[3]
        return chr(int(code, 16)) if code and int(code, 16) < 0x110000 else _JS_CONTROL.get(m[4], m[4] or "")
    return _JS_ESCAPE.sub(one, literal[1:-1]) if "\\" in literal else literal[1:-1]


def js_tokens(text: str):
    """(kind, value, place) of a source, comments left out. A template's text is skipped, the
    expressions inside it are not."""
    at, last, templates, depth = 0, ("punct", ";"), [], 0
    while at < len(text):
        c = text[at]
        if c == "`" or (c == "}" and templates and templates[-1] == depth):
            if c == "}":
                templates.pop()
                depth -= 1
                yield "punct", "}", at
            at = _JS_PLAIN.match(text, at + 1).end()
            if text.startswith("${", at):
                depth += 1
                templates.append(depth)
                yield "punct", "${", at
                at, last = at + 2, ("punct", "{")
            else:
                yield "template", "", at
                at, last = at + 1, ("string", "")
            continue
        m = _JS_TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        kind, value = m.lastgroup, m[0]
        if value == "/" and (last[1] in _NOT_CALLED or (last[0] in ("punct", "arrow") and last[1] not in (")", "]", "}"))):
            m = _JS_REGEX.match(text, at) or m
            kind = "pattern"
        at = m.end()
        if kind == "comment":
            continue
        if kind == "punct":
            depth += (value == "{") - (value == "}")
        yield kind, value, m.start()
        last = (kind, value)


def js_properties(text: str) -> list[tuple]:
    """Object properties with a string literal for value, in order: (key, value, place of the
    literal, callee), where callee is None unless the object is an argument of a call, and
    else (place, root name if the call is of its member)."""
    out, stack = [], []  # stack: [bracket, callee if a call's parenthesis or its direct object]
    chain = None  # the expression before a parenthesis: [place, root name, member, optional, new]
    before, key, value = ("punct", ";", 0), None, None
    for kind, v, at in js_tokens(text):
        if value is not None:  # a literal is the whole value only if the property ends here
            if v in (",", "}"):
                out.append((key[0], js_text(value[0]), value[1], stack[-1][1] if stack and stack[-1][0] == "{" else None))
            key = value = None
        if v == ":" and kind == "punct" and key is not None and before[2] == key[1]:
            pass
        elif kind == "string" and key is not None and before[1] == ":":
            value = (v, at)
        else:
            key = None
            if before[1] in ("{", ",") and stack and stack[-1][0] == "{" and kind in ("name", "string"):
                key = (v if kind == "name" else js_text(v), at)
        if kind == "name" and before[1] in (".", "?.") and chain:
            chain[2] = True
        elif kind == "name":
            chain = None if v in _NOT_CALLED else [at, v, False, False, before[1] == "new" or (before[1] == "." and chain is not None and chain[4])]
            if before[1] == "." and chain:
                chain[1:3] = [None, True]
        elif kind == "chain" and chain:
            chain[3] = True
        elif v in ("(", "[", "{", "${"):
            call = None
            if v == "(" and (chain or before[1] in (")", "]")) and not (chain and (chain[3] or chain[4])):
                call = (chain[0], chain[1] if chain[2] else None) if chain else (at, None)
            elif v == "{" and stack and stack[-1][0] == "(" and before[1] in ("(", ","):
                call = stack[-1][1]
            stack.append(["{" if v == "${" else v, call, chain if v in "([" else None])
            chain = None
        elif v in (")", "]", "}") and kind == "punct":
            opened = stack.pop() if stack else ["", None, None]
            # What follows a call or an index goes on with the same root.
            chain = [opened[2][0], None if v == ")" else opened[2][1], opened[2][2], opened[2][3], False] if opened[2] else None
        elif v not in (".",):
            chain = None
        before = (kind, v, at)
    return out


def js_imports(text: str) -> list[tuple[int, str, str]]:
    """(place, package, local name) of every import outside comments."""
    code = list(text)
    for m in _JS_TOKEN.finditer(text):
        if m.lastgroup == "comment":
            code[m.start():m.end()] = [c if c == "\n" else " " for c in m[0]]
    out = []
    for m in _JS_IMPORT.finditer("".join(code)):
        spec = m[1]
        named = re.search(r"\{([^}]*)\}", spec)
        names = [re.match(r"\s*([A-Za-z_$][\w$]*)", spec), re.search(r"\*\s*as\s+([A-Za-z_$][\w$]*)", spec)]
        names += [re.search(r"([A-Za-z_$][\w$]*)\s*$", n) for n in named[1].split(",")] if named else []
        out += [(m.start(), m[2], n[1]) for n in names if n]
    return out


# ---------------------------------------------------------------------------- YAML
class Invalid(ValueError):
    """Not a YAML document this reader accepts."""


_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', re.S)
_KEY = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[?:-](?=\S))(?:[^\n:#]|:(?=\S)|(?<!\s)\#)*?)\s*:(?=\s|\Z)""")
_MARK = re.compile(r"(?:[&!][^\s,\[\]{}]*\s+)+")


def _unquote(s: str) -> str:
    return js_text(s) if s[0] == '"' else s[1:-1].replace("''", "'")


def _flow(text: str, at: int, emit) -> int:
    """Read a flow collection that begins at ``at``; returns the place after it."""
    stack, key, scalar = [], None, None  # stack: [closing bracket, keys]
    while at < len(text):
        c = text[at]
        if c in " \t\r\n":
            at += 1
            continue
        if c == "#" and text[at - 1] in " \t\n":
            at = (text.find("\n", at) + 1) or len(text)
            continue
        if c in "[{":
            if scalar is not None:
                raise Invalid("collection after a scalar")
            stack.append(("]" if c == "[" else "}", set(), key))
            key, at = None, at + 1
        elif c in ",]}":
            if key is not None and isinstance(scalar, str):
                emit(key, scalar)
            key, scalar, at = None, None, at + 1
            if c != ",":
                if stack.pop()[0] != c:
                    raise Invalid("brackets do not match")
                if not stack:
                    return at
                scalar = ()  # a collection stands where a scalar could
        elif c == ":" and (text[at + 1:at + 2] in " \t\r\n,[]{}" or text[at - 1] in "\"'"):
            if key is not None or not (scalar is None or isinstance(scalar, str)):
                raise Invalid("a mapping value where none can be")
            key, scalar, at = scalar or "", None, at + 1
            if stack[-1][0] == "}":
                if key in stack[-1][1]:
                    raise Invalid("duplicated key")
                stack[-1][1].add(key)
        else:
            m = _QUOTED.match(text, at) if c in "\"'" else re.compile(r"(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s,\[\]{}:#]))+").match(text, at)
            if not m or scalar is not None:
                raise Invalid("scalar")
            scalar, at = (_unquote(m[0]) if c in "\"'" else m[0].strip()), m.end()
    raise Invalid("not closed")


def yaml_strings(text: str) -> list[tuple[str, str]] | None:
    """(key, scalar) of every mapping entry at any depth, block or flow, in order; None if the
    text is not one valid document. Numbers and flags come as written; aliases are not
    followed."""
    out: list[tuple[str, str]] = []
    emit = lambda k, v: out.append((k, v))
    try:
        _blocks(text.replace("\r\n", "\n"), emit)
    except Invalid:
        return None
    return out


def _blocks(text: str, emit) -> None:
    stack = [[-1, "", None]]  # [column, "map" or "seq" or "", keys]
    want, plain, begun, at = -1, None, False, 0  # column whose entry waits for a value; column whose scalar may go on
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        body = line.lstrip(" ")
        if not body.strip() or body.lstrip("\t").startswith("#"):
            at = end + 1
            continue
        if line.startswith("%") and not begun:
            at = end + 1
            continue
        if re.match(r"(---|\.\.\.)(\s|$)", line):
            if begun and line[0] == "-":
                raise Invalid("more than one document")
            begun, plain, at = True, None, at + 3 if line[0] == "-" else len(text)
            if line[0] == "-" and not line[3:].strip():
                at = end + 1
            continue
        if body[0] == "\t":
            raise Invalid("tab")
        begun, col = True, len(line) - len(body)
        if plain is not None and col > plain:  # a scalar of several lines
            if _KEY.match(body):
                raise Invalid("a mapping value where none can be")
            at = end + 1
            continue
        plain, at = None, at + col
        while text[at:at + 1] == "-" and text[at + 1:at + 2] in ("", " ", "\n"):
            _enter(stack, col, "seq", want)
            want = col
            rest = text[at + 1:end]
            step = 1 + len(rest) - len(rest.lstrip(" "))
            at, col = at + step, col + step
            if at >= end:
                break
        if at >= end or text[at] == "#":
            at = end + 1
            continue
        mark = _MARK.match(text, at, end)
        key = _KEY.match(text, mark.end() if mark else at, end)
        name = None
        if key:
            name = _unquote(key[1]) if key[1][0] in "\"'" else key[1]
            _enter(stack, col, "map", want)
            if name in stack[-1][2] and name != "<<":
                raise Invalid("duplicated key")
            stack[-1][2].add(name)
            want, at = col, key.end()
            owner = col
        else:
            if want is None:
                raise Invalid("bad indentation")
            owner = stack[-1][0]
        at += len(text[at:end]) - len(text[at:end].lstrip(" \t"))
        mark = _MARK.match(text, at, end)
        at = mark.end() if mark else at
        if at >= end or text[at] == "#" or re.fullmatch(r"[&!]\S*\s*", text[at:end]):
            at = end + 1
            continue
        want = None
        c = text[at]
        if c in "|>":
            at = end + 1
            while at < len(text):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                line = text[at:end]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= owner:
                    break
                at = end + 1
            continue
        if c in "[{":
            at = _flow(text, at, emit)
        elif c in "\"'":
            m = _QUOTED.match(text, at)
            if not m:
                raise Invalid("not closed")
            if name is not None:
                emit(name, _unquote(m[0]))
            at = m.end()
        else:
            value = re.split(r"\s#", text[at:end], maxsplit=1)
            if c in "@`%" or re.search(r":(\s|$)", value[0]):
                raise Invalid("plain scalar")
            if name is not None:
                emit(name, value[0].strip())
            plain, at = (owner if len(value) == 1 else None), end + 1
            continue
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if text[at:end].strip() and not re.match(r"\s+#", text[at:end]):
            raise Invalid("text after a value")
        at = end + 1


def _enter(stack: list, col: int, kind: str, want: int | None) -> None:
    """Go to the collection of this kind at this column; open it if an entry waits for it."""
    while stack[-1][0] > col:
        stack.pop()
    top = stack[-1]
    if top[0] == col and top[1] == kind:
        return
    waits = want is not None and top[0] == want and (col > want or (kind == "seq" and top[1] == "map"))
    if not waits:
        if top[0] == col and top[1] == "seq" and kind == "map" and len(stack) > 1 and stack[-2][:2] == [col, "map"]:
            stack.pop()  # a list at its key's own column ends here
            return
        raise Invalid("bad indentation")
    stack.append([col, kind, set()])


# ---------------------------------------------------------------------------- JSON
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+')


def redact_members(text: str, secret: str, mark: str) -> str:
    """A JSON text with the whole value of every member whose key matches ``secret``, at any
    depth and of any type, replaced by the string ``mark``."""
    names, out, done, at = re.compile(secret), [], 0, 0
    found = list(_JSON_TOKEN.finditer(text))
    while at < len(found):
        key = found[at][0]
        if key[0] == '"' and found[at + 1:at + 2] and found[at + 1][0] == ":" and at + 2 < len(found) and names.search(js_text(key)):
            first = last = at + 2
            depth = (found[last][0] in "[{") - (found[last][0] in "]}")
            while depth > 0 and last + 1 < len(found):
                last += 1
                depth += (found[last][0] in "[{") - (found[last][0] in "]}")
            out += [text[done:found[first].start()], '"' + mark + '"']
            done, at = found[last].end(), last
        at += 1
    return "".join(out) + text[done:]
