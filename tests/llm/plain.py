"""Plain versions of operators 5, 6 and 7: loops over everything, for small tables."""

from collections import defaultdict

import regex

from tidemill.llm import decontaminate as d
from tidemill.llm import line_dedup, sharding


# --- 5 -------------------------------------------------------------------------------------------------------------------
def shards(points, count, dimensions=sharding.DIMENSIONS):
    """points: dicts with name, bytes and, by dimension, q_ and k_. Gives {name: shard} by recursive weighted medians."""
    spans = {x: max(p[f"q_{x}"] for p in points) - min(p[f"q_{x}"] for p in points) for x in dimensions}
    out = {}

    def split(held, first, leaves):
        if leaves == 1:
            out.update({p["name"]: first for p in held})
            return
        half = leaves // 2
        if not held:
            return
        widths = {x: (max(p[f"q_{x}"] for p in held) - min(p[f"q_{x}"] for p in held)) / (spans[x] or 1) for x in dimensions}
        widest = max(dimensions, key=lambda x: widths[x])
        wanted, below, left = sum(p["bytes"] for p in held) * half / leaves, 0, []
        rest = sorted(held, key=lambda p: p[f"k_{widest}"])
        while rest and below + rest[0]["bytes"] < wanted:
            left.append(rest.pop(0))
            below += left[-1]["bytes"]
        if rest and below + rest[0]["bytes"] - wanted <= wanted - below:  # the nearer edge
            left.append(rest.pop(0))
        split(left, first, half)
        split(rest, first + half, leaves - half)

    split(points, 0, count)
    return out


# --- 6 -------------------------------------------------------------------------------------------------------------------
def template(text):
    """(words, {place: (kind, value)})"""
    plain = (text or "").translate(str.maketrans("#~@", "   "))
    counted = regex.sub(d.NUMBER, " # ", plain)
    named = regex.sub(d.UNIT, r"\1~ ", counted)
    values = {
        "#": iter(regex.findall(d.NUMBER, plain)),
        "~": iter([regex.sub("^# +", "", m[0]).lower() for m in regex.finditer(d.UNIT, counted)]),
        "@": iter([m[0] for m in regex.finditer(d.NAME, named)]),
    }
    words = [w for w in regex.split(r"[^\p{L}#~@]+", regex.sub(d.NAME, "@", named).lower()) if w]
    return words, {i: (w, next(values[w])) for i, w in enumerate(words) if w in values}


def contaminated(documents, items):
    """The set of (doc_id, item_id) out of {id: text}."""
    out = set()
    for item_id, item in items.items():
        words, slots = template(item)
        size = min(len(words), d.SHORT_WINDOW if len(words) < d.SHORT else d.WINDOW)
        if not size:
            continue
        own = {at: tuple(words[at : at + size]) for at in range(len(words) - size + 1)}
        own = {at: w for at, w in own.items() if any(x not in "#~@" for x in w)}
        n_windows = len(set(own.values()))
        for doc_id, text in documents.items():
            theirs, doc_slots = template(text)
            at_of = defaultdict(list)
            for at in range(len(theirs) - size + 1):
                at_of[tuple(theirs[at : at + size])].append(at)
            places = [(at, item_at, w) for item_at, w in own.items() for at in at_of[w]]
            if places and any(_passes(group, key, n_windows, size, slots, doc_slots) for key, group in _alignments(places).items()):
                out.add((doc_id, item_id))
    return out


def _alignments(places):
    support = defaultdict(int)
    for at, item_at, _ in places:
        support[at - item_at] += 1
    groups = defaultdict(dict)
    for at, item_at, w in places:
        shift = at - item_at
        for key in (("s", shift), ("a", shift // d.BAND), ("b", (shift + d.BAND // 2) // d.BAND)):
            best = groups[key].get(item_at)
            if best is None or (-support[shift], shift) < (-support[best[0]], best[0]):
                groups[key][item_at] = shift, w
    out = {key: [(item_at, shift, w) for item_at, (shift, w) in group.items()] for key, group in groups.items()}
    first = {}
    for at, item_at, w in places:
        a, i = first.get(w, (at, item_at))
        first[w] = min(a, at), min(i, item_at)
    out["first", 0] = [(i, a - i, w) for w, (a, i) in first.items()]
    return out


def _passes(group, key, n_windows, size, slots, doc_slots):
    places = sorted(item_at for item_at, _, _ in group)
    run = best = 0
    for i, at in enumerate(places):
        run = run + 1 if i and at == places[i - 1] + 1 else 1
        best = max(best, run + size - 1)
    covered = len({w for _, _, w in group}) >= d.COVERAGE * n_windows
    if not covered and not (key[0] == "s" and best >= d.RUN):
        return False
    values, held = defaultdict(set), defaultdict(set)
    for item_at, shift, _ in group:
        for at in range(item_at, item_at + size):
            if at in slots and doc_slots.get(at + shift, ("",))[0] == slots[at][0]:
                values[slots[at]].add(doc_slots[at + shift][1])
                held[slots[at]].add(at)
    total = sum(map(len, held.values()))
    return sum(len(held[x]) for x in held if len(values[x]) == 1) >= d.CONSISTENT * total


# --- 7 -------------------------------------------------------------------------------------------------------------------
def _field(token):
    return any(c in "0123456789@" for c in token) or "://" in token


def templates(line):
    tokens = [None if _field(t) else t for t in line.split()]
    n, fixed = len(tokens), sum(t is not None for t in tokens)
    if not n:
        return set()

    def without(*stretches):
        gone = {i for lo, hi in stretches for i in range(lo, hi)}
        return (tuple(stretches), *("..." if i in gone else t for i, t in enumerate(tokens)))

    out = {without()}
    if n < line_dedup.LONG:
        if 4 * (fixed - 1) >= 3 * n:
            out |= {without((i, i + 1)) for i, t in enumerate(tokens) if t is not None}
        return out
    depth, parts = line_dedup.DEPTH, line_dedup.PARTS
    cuts = [depth + (n - depth) * k // parts for k in range(parts + 1)]
    stretches = [(0, depth), *zip(cuts, cuts[1:], strict=False)]

    def constant(*gone):
        return fixed - sum(tokens[i] is not None for lo, hi in gone for i in range(lo, hi))

    out |= {without(s) for s in stretches[1:]}
    if 4 * constant(stretches[0]) >= 3 * n:
        out.add(without(stretches[0]))
    for i in range(1, parts + 1):
        for j in range(i + 1, parts + 1):
            if 2 * constant(stretches[i], stretches[j]) >= n:
                out.add(without(stretches[i], stretches[j]))
    return out


def _pairs(lines):
    out = set()
    for words in map(str.split, lines):
        out |= set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} if words else set()
    return out


def dropped_lines(texts):
    """The line numbers that each text loses: a template recurs if enough pairwise unrelated texts hold it."""
    split = [(t or "").split("\n") for t in texts]
    own = [[templates(line) for line in lines] for lines in split]
    holders = defaultdict(list)
    for i, lines in enumerate(own):
        for t in set().union(*lines):
            holders[t].append(i)
    recurring = set()
    for t, found in holders.items():
        picked = []
        for i in found:
            rest = _pairs(line for line, held in zip(split[i], own[i], strict=True) if t not in held)
            if all(len(rest & other) < line_dedup.RELATED * len(rest | other) for other in picked):
                picked.append(rest)
        if len(picked) >= line_dedup.CONTEXTS:
            recurring.add(t)
    return [[k for k, held in enumerate(lines) if held & recurring] for lines in own]
