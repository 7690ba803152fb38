"""A conservative reader of shell commands: literal words, pipelines and lists, or a refusal.

What it accepts has exactly the words the shell would pass. Everything dynamic is refused with a
``Refused``: expansions, substitutions, braces, leading globs, redirects other than the merging of the
two output streams, here-documents, subshells, background jobs, comments and unfinished quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MOST_BYTES, MOST_STAGES, MOST_NODES = 256 * 1024, 256, 16_384
# Fixed values.
COMPOUND = {
    "if": "conditional", "case": "conditional", "[[": "test_command", "for": "loop", "while": "loop", "until": "loop", "select": "loop",
    "function": "function", "{": "group",
}
WRAPPERS = ("env", "command", "exec", "time", "timeout")
SHELLS = ("bash", "sh", "zsh", "dash", "ksh", "fish")
FEATURES = (
    "pipeline", "and_list", "or_list", "sequence", "background", "multiline", "parameter_expansion", "command_substitution", "redirection", "comment",
    "heredoc", "loop", "conditional", "function", "subshell", "path_invocation", "wrapper", "nested_shell", "parser_failure",
)


class Refused(ValueError):
    """The command is not one of literal words, lists and pipelines."""


@dataclass
class Simple:
    words: list[str]
    merges: list[str] = field(default_factory=list)


@dataclass
class Program:
    """items: each a list of stages (one: a simple command); connectors between items: and, or, sequence."""

    items: list[list[Simple]]
    connectors: list[str]


_LEX = re.compile(
    r"""(?P<blank>[ \t]+)|(?P<merge>2>&1|1>&2)(?![^\s;|&])|(?P<op>\|\||&&|\|&|;;|[|;\n])|(?P<bad>[&<>()#`$\r])|(?P<word>(?:'[^']*'|"(?:[^"\\`$]|\\[^\r\n])*"|\\[^\r\n]|[^\s'"\\|&;<>()`$#])(?:'[^']*'|"(?:[^"\\`$]|\\[^\r\n])*"|\\[^\r\n]|[^\s'"\\|&;<>()`$])*)"""
)
_PART = re.compile(r"""'(?P<single>[^']*)'|"(?P<double>(?:[^"\\]|\\.)*)"|\\(?P<escape>.)|(?P<plain>.)""", re.S)


def _decode(raw: str) -> str:
    out = ""
    for m in _PART.finditer(raw):
        if m["single"] is not None:
            out += m["single"]
        elif m["double"] is not None:
            out += re.sub(r"\\(.)", r"\1", m["double"], flags=re.S)
        elif m["escape"] is not None:
            out += m["escape"]
        else:
            c = m["plain"]
            if c in "*?[" and (not out or out.startswith("-")):
                raise Refused("pathname expansion")
            if c in "{}#":
                raise Refused("brace expansion or comment")
            out += c
    return out


def parse(source: str) -> Program:
    """The program that a command spells; raises Refused."""
    if len(source.encode()) > MOST_BYTES:
        raise Refused("too long")
    items, connectors, stages, words, merges, at, nodes = [], [], [], [], [], 0, 0
    text = source.strip(" \t\n")

    def end_stage():
        nonlocal words, merges
        if not words:
            raise Refused("empty command")
        if words[0] in COMPOUND or words[0] == "!" or words[0] == "coproc":
            raise Refused("compound command")
        stages.append(Simple(words, merges))
        if len(stages) > MOST_STAGES:
            raise Refused("too many stages")
        words, merges = [], []

    def end_item():
        nonlocal stages
        end_stage()
        items.append(stages)
        stages = []

    while at < len(text):
        m = _LEX.match(text, at)
        nodes += 1
        if not m or nodes > MOST_NODES or m["bad"]:
            raise Refused("dynamic or unfinished syntax")
        at, op = m.end(), m["op"]
        if m["word"]:
            words.append(_decode(m["word"]))
        elif m["merge"]:
            if not words:
                raise Refused("redirect without a command")
            merges.append(m["merge"])
        elif op in ("|&", ";;"):
            raise Refused("unsupported operator")
        elif op == "|":
            end_stage()
            at = re.compile(r"\s*").match(text, at).end()
            if at >= len(text):
                raise Refused("unfinished pipeline")
        elif op:
            end_item()
            rest = re.compile(r"\s*").match(text, at).end()
            if rest >= len(text):
                if op in ("&&", "||"):
                    raise Refused("unfinished list")
                at = rest
                break
            at = rest
            connectors.append({"&&": "and", "||": "or"}.get(op, "sequence"))
    if words or stages or not items:
        end_item()
    return Program(items, connectors[: len(items) - 1])


def simple_words(source: str) -> list[str]:
    """The words of exactly one simple command without merges; raises Refused."""
    p = parse(source)
    if len(p.items) != 1 or len(p.items[0]) != 1 or p.items[0][0].merges:
        raise Refused("not one simple command")
    return p.items[0][0].words


def features(source: str) -> list[str]:
    """Labels of the syntax a command uses, in the order of FEATURES; none for a simple command."""
    found, quote, i, word_start, n = set(), None, 0, True, len(source)
    while i < n:
        c, two = source[i], source[i : i + 2]
        if quote == "'":
            quote = None if c == "'" else quote
        elif c == "\\":
            i += 1
        elif c == "'" and quote is None:
            quote = "'"
        elif c == '"':
            quote = None if quote else '"'
        elif two == "$(" or c == "`":
            found.add("command_substitution")
            i += two == "$("  # its parenthesis opens no subshell
        elif c == "$":
            found.add("parameter_expansion")
        elif quote is None:
            if two == "||":
                found.add("or_list")
                i += 1
            elif two == "&&":
                found.add("and_list")
                i += 1
            elif two == "<<":
                found |= {"heredoc", "redirection"}
                i += 1
            elif c == "|":
                found.add("pipeline")
            elif c == ";":
                found.add("sequence")
            elif c in "<>":
                found.add("redirection")
                i += source[i + 1 : i + 2] == "&"
            elif c == "&":
                found.add("background")
            elif c == "\n":
                found.add("multiline")
            elif c == "#" and word_start:
                found.add("comment")
                i = (source + "\n").index("\n", i) - 1
            elif c == "(":
                found.add("function" if re.match(r"\(\s*\)", source[i:]) else "subshell")
        word_start = source[i : i + 1] in " \t\n;|&("
        i += 1
    for m in re.finditer(r"(?:^|[|;&\n(]|\bdo\b|\bthen\b)\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*([^\s;|&()]+)", source):
        head = m[1].strip("'\"")
        if COMPOUND.get(head) in FEATURES:
            found.add(COMPOUND[head])
        if head in WRAPPERS:
            found.add("wrapper")
        if head.rpartition("/")[2] in SHELLS:
            found.add("nested_shell")
        if "/" in head:
            found.add("path_invocation")
    if quote:
        found.add("parser_failure")
    return [f for f in FEATURES if f in found]
