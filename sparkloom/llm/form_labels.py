"""A rater of text forms: reads a text line by line and tells which form more than half of its characters have.

Its labels of a bounded sample of real documents are what the rules of ``text_forms`` are learned from; no other document is read
by it. Tables with few documents are filled up with composed ones, whose form is known.
"""

from __future__ import annotations

import random
import re

from sparkloom.llm.languages import STOPWORDS

FORMS = ["junk", "table", "list"]
ENTRIES = ("marked", "linked", "leaders", "inline", "defined", "brief")
JUNK = ("log", "dump", "spaced", "noise", "heap")
KINDS = (*ENTRIES, "cells", *JUNK, "prose")
#: Articles, which a heap of words can have as well.
ARTICLES = frozenset("the a an der die das den dem des ein eine einen einem einer eines le la les l un une el los las unos unas".split())
GLUE = frozenset(w for words in STOPWORDS.values() for w in words.split()) - ARTICLES

_MARK = re.compile(r"(?:[-*•‣◦·–—+»]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\[[ xX]\]|\[\w{1,6}\])\s+\S")
_LINK = re.compile(r"\S.*\s<?(?:https?://|www\.)\S+$|^<?(?:https?://|www\.)\S+$")
_LEADER = re.compile(r"\S\s*(?:\.\s?){4,}\s*\d*$")
_RULE = re.compile(r"[|│┃+:\-=─━┼┬┴├┤┌┐└┘\s]{4,}$")
_CSV = re.compile(r"^(?:\"[^\"]*\"|[^,\"]*)(?:,(?! )(?:\"[^\"]*\"|[^,\"]*)){2,}$")
_SEMI = re.compile(r"^(?:\"[^\"]*\"|[^;\"]*)(?:;(?! )(?:\"[^\"]*\"|[^;\"]*)){1,}$")
_ALIGNED = re.compile(r"\S {3,}\S")
_LOG = re.compile(r"\[?(?:\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|[A-Z][a-z]{2} \d\d? \d\d:\d\d)|(?:INFO|WARN|WARNING|ERR|ERROR|DEBUG|TRACE|FATAL)\b[ :\[]")
_DUMP = re.compile(r"(?:[0-9a-f]{6,}:?\s+)?(?:[0-9a-fA-F]{2,4}\s){6,}|[A-Za-z0-9+/=]{40,}$|(?:0x[0-9a-fA-F]+[\s,]*){3,}")
_SPACED = re.compile(r"(?:\w ){5,}\w?")
_END = re.compile(r"[.!?…]+[\"”’)]*(?:\s|$)")
_INSIDE = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-–—‘’“”„«»…/%&·•]|[ÃÂÐ�]|(?<=\w)[¿§¶¤€™](?=\w)")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")


def shape(line: str, odd: int) -> str | None:
    """What a line with ``odd`` unusual characters looks like alone; None where the lines around it decide."""
    if _LOG.match(line):
        return "log"
    if _DUMP.match(line):
        return "dump"
    if _SPACED.search(line) and len(_SPACED.sub("", line)) * 2 < len(line):
        return "spaced"
    if ("..." in line or ". ." in line) and _LEADER.search(line):
        return "leaders"
    bars = line.count("|") + line.count("│") + line.count("┃")
    ruled = len(line) > 3 and _RULE.match(line)
    if ruled or (bars >= 2 and (odd - bars) * 4 < len(line)) or (bars and (odd - bars) * 10 < len(line)):
        return "cells"
    linked = ("://" in line or "www." in line) and _LINK.match(line)
    if (odd - bars) * 9 > len(line) and not linked:
        return "noise"
    if "\t" in line or "   " in line and _ALIGNED.search(line) and not _END.search(line[:-1]):
        return "cells"
    if linked:
        return "linked"
    if _MARK.match(line):
        return "marked"
    if line.count(",") - line.count(", ") >= 2 and _CSV.match(line):
        return "cells"
    if ";" in line:
        if _SEMI.match(line) and not _END.search(line):
            return "cells"
        if line.count("; ") >= 2 and not _END.search(line[:-1]) or line.endswith(";") and line.count(";") >= 2:
            return "inline"
    return None


def parts(text: str | None, skip: frozenset[int] | set[int] = frozenset()) -> dict[str, int]:
    """Characters of stripped lines by kind, the lines numbered in ``skip`` aside."""
    sizes: dict[str, int] = dict.fromkeys(KINDS, 0)
    block: list[str] = []

    def close() -> None:
        """Lines that follow each other without a blank one: prose, brief entries or a heap of words."""
        if not block:
            return
        size = sum(map(len, block))
        joined = " ".join(block)
        stops = len(_END.findall(joined))
        tokens = [t.strip(".,:;") for t in joined.lower().split()]
        glue = sum(t in GLUE for t in tokens)
        if len(tokens) >= 12 and glue * 25 < len(tokens) and size >= 40 * len(block):
            sizes["heap"] += size  # no sentence does without words that tie others together
        elif stops and (size < 260 * stops or block[-1][-1:] in ".!?…\"”"):
            plain = [x for x in block if len(x) >= 60 or _END.search(x)]
            loose = 0
            if stops < len(block) and sum(map(len, plain)) < size // 2 and max(map(len, block)) < 60 and stops * 4 < len(block):
                loose = sum(len(x) for x in block if not _END.search(x))  # entries with a sentence among them
            sizes["brief"] += loose
            sizes["prose"] += size - loose
        elif size / len(block) >= 55 and len(tokens) >= 12:
            kept = len(set(tokens)) * 10 > 7 * len(tokens) and re.search(r"[,:]", joined)
            sizes["prose" if kept else "heap"] += size
        else:
            for x in block:
                sizes["defined" if ": " in x[:-1] else "brief"] += len(x)
        block.clear()

    for number, raw in enumerate((text or "").split("\n")):
        line = _INVISIBLE.sub("", raw).replace("\xa0", " ").strip() if number not in skip else ""
        if not line:
            if number not in skip:
                close()
            continue
        kind = shape(line, len(_ODD.findall(line)))
        if kind is None:
            block.append(line)
        else:
            close()
            sizes[kind] += len(line)
    close()
    return sizes


def form(text: str | None, skip: frozenset[int] | set[int] = frozenset()) -> str:
    """The form that holds more than half of the characters; ``prose`` where none of the others does."""
    sizes = parts(text, skip)
    total = sum(sizes.values())
    share = {"junk": sum(sizes[k] for k in JUNK), "table": sizes["cells"], "list": sum(sizes[k] for k in ENTRIES)}
    return next((f for f in FORMS if share[f] * 2 > total), "prose")


# ---- composed documents, for tables with few real ones ------------------------------------------------------------

_NOUNS = "river engine meadow lantern harvest signal bridge kettle orchard compass quarry ferry loom archive pump valley beacon cellar garden tower".split()
_ADJECTIVES = "old quiet narrow heavy plain early late broken steady public small deep".split()


def _passage(kind: str, rng: random.Random) -> list[str]:
    """Some lines of one form."""
    noun, adj = lambda: rng.choice(_NOUNS), lambda: rng.choice(_ADJECTIVES)
    name = lambda: "".join(rng.choice(["ka", "mor", "tel", "vin", "dra", "sul", "ben", "or"]) for _ in range(3)).title()
    entry = lambda: rng.choice([lambda: f"{adj()} {noun()} of {name()}", lambda: f"{noun()} ({name()})", lambda: f"{noun()}, {noun()} and {noun()}", lambda: f"{name()} {noun()}"])()
    cell = lambda: rng.choice([str(rng.randint(1, 9999)), f"{rng.random() * 99:.2f}", "n/a", "-", name(), f"{rng.randint(1, 99)}%"])
    n = rng.randint(4, 14)
    if kind == "prose":
        told = " ".join(f"{rng.choice(['The', 'A', 'Every'])} {adj()} {noun()} near {name()} {rng.choice(['was seen', 'had been moved', 'is kept'])} {rng.choice(['before', 'after', 'beside'])} the {noun()} and the {adj()} {noun()}{rng.choice(['', ', they say', ' of ' + name()])}." for _ in range(n))
        if rng.random() < 0.5:
            return [told]
        wide, out = rng.randint(50, 90), [""]
        for word in told.split():
            if len(out[-1]) + len(word) > wide:
                out.append("")
            out[-1] = f"{out[-1]} {word}".strip()
        return out
    if kind == "list":
        form = rng.choice(["mark", "number", "brief", "inline", "link", "leader", "defined", "cited"])
        if form == "inline":
            return ["; ".join(entry() for _ in range(rng.randint(4, 8))) for _ in range(max(1, n // 3))]
        mark = rng.choice(["- ", "* ", "• ", "– "])
        make = {"mark": lambda i: mark + entry(), "number": lambda i: f"{i + 1}{rng.choice('.)')} {entry()}", "brief": lambda i: entry(), "link": lambda i: f"{entry()} https://{name().lower()}.example/{noun()}", "leader": lambda i: f"{entry()} {'.' * rng.randint(6, 30)} {i + 3}", "defined": lambda i: f"{name()}: {entry()}", "cited": lambda i: f"[{rng.choice('abcdef')}{i + 1}] {name()} {rng.choice('ABCDEFG')}. {entry().capitalize()}. {rng.randint(1950, 2024)}."}[form]
        return [make(i) for i in range(n)]
    if kind == "table":
        form, k = rng.choice(["bar", "box", "tab", "comma", "semi", "aligned"]), rng.randint(2, 5)
        rows = [[entry() if form != "comma" else f'"{entry()}"', *(cell() for _ in range(k))] for _ in range(n)]
        if form == "bar":
            return [f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * (k + 1), *rows[1:]]]
        if form == "aligned":
            return ["".join(c.ljust(28) for c in r).rstrip() for r in rows]
        return [{"box": " │ ", "tab": "\t", "comma": ",", "semi": ";"}[form].join(r) for r in rows]
    form = rng.choice(["log", "hex", "spaced", "noise", "heap", "salad", "broken"])
    if form == "log":
        return [f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T0{rng.randint(0, 9)}:11:{rng.randint(10, 59)}Z {rng.choice(['INFO', 'WARN', 'ERR'])} {noun()}[{rng.randint(1, 9999)}]: {noun()}={rng.getrandbits(40):x}" for _ in range(n)]
    if form == "hex":
        return [" ".join(f"{rng.getrandbits(8):02x}" for _ in range(16)) + "  " + "".join(rng.choice("#.ax|~Q") for _ in range(16)) for _ in range(n)]
    if form == "spaced":
        return [" ".join(f"{noun()}{name()}") for _ in range(n)]
    if form == "noise":
        return ["".join(rng.choice("!@#$%^*~=<>?/\\|:. ") for _ in range(rng.randint(20, 60))) + f" {name()} {name()}" for _ in range(n)]
    if form == "heap":
        few = [noun(), noun(), noun(), name(), name()]
        return [" ".join(rng.choice(few) for _ in range(rng.randint(14, 40))) for _ in range(max(1, n // 3))]
    if form == "salad":
        return [" ".join([noun() if rng.random() < 0.7 else name().lower() for _ in range(14)]).capitalize() + "." for _ in range(n)]
    told = " ".join(_passage("prose", rng))
    return ["".join(rng.choice("€¤¶§Ã�™¿Âœ") if c.isalpha() and rng.random() < 0.35 else c for c in told)]


def composed(count: int, seed: int = 11) -> list[tuple[str, str]]:
    """(text, form) of composed documents: passages of a main form and of others, and the form that holds more than half of the characters."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        main = ["prose", *FORMS][i % 4]
        sizes, blocks = dict.fromkeys(["prose", *FORMS], 0), []
        for _ in range(rng.randint(1, 5)):
            kind = main if rng.random() < 0.9 else rng.choice(["prose", "prose", *FORMS])
            lines = _passage(kind, rng)
            sizes[kind] += sum(map(len, lines))
            blocks.append("\n".join(lines))
        total = sum(sizes.values())
        out.append(("\n\n".join(blocks), next((k for k in FORMS if sizes[k] * 2 > total), "prose")))
    return out
