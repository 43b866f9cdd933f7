"""Scalar functions on descriptions: Column in, Column out, nothing but built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import dims
from tallyspark.functions.values import let, listed


#: Array of constants, under the name that other modules know.
literals = listed


def among(w: Column, values: list[str]) -> Column:
    """Whether w is one of many constants."""
    return F.array_contains(listed(values), w)


def spaced_out(s: Column, kept: str) -> Column:
    """Runs of characters that are not kept as one space, in one pass. White space is not kept; a single space, the usual case, is no
    match, and a kept character is left by the first look."""
    return F.regexp_replace(s, f"(?![{kept}])(?: [^{kept}]+|[^ {kept}][^{kept}]*)", " ")


def normalize(s: Column) -> Column:
    """Upper case; all but letters, digits and . * / - as spaces; single spaces; trimmed."""
    return F.trim(spaced_out(F.upper(s), "A-Z0-9.*/-"))


def dedup_key(s: Column) -> Column:
    """What descriptions of one merchant share: runs of four digits or more are '#', other signs spaces."""
    long_numbers = F.regexp_replace(F.upper(s), r"\d{4,}", "#")
    return F.trim(spaced_out(long_numbers, "A-Z0-9#"))


def ways(pattern: str) -> list[str]:
    """The alternatives of a pattern."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def begun(pattern: str) -> str:
    """A pattern whose alternatives all begin with a word's beginning and a letter or digit, with that looked for first: a place is
    left by its character, before any alternative is tried. Other patterns as they are."""
    own = ways(pattern)
    if not all(re.match(r"\\b[A-Z0-9](?![?*+{])", w) for w in own):
        return pattern
    first = "".join(sorted({w[2] for w in own}))
    return rf"(?=[{first}])\b(?:{'|'.join(w[2:] for w in own)})"


def is_qris(n: Column) -> Column:
    """Whether normalised text n is a QRIS payment."""
    return n.rlike(begun("|".join(dims.QRIS_PATTERNS)))


def or_null(s: Column) -> Column:
    return F.when(s != "", s)


def qris_meta(n: Column) -> Column:
    """The technical fields of a QRIS description, normalised: struct(nmid, mpan, terminal_id, reference, acquirer, name_hint)."""
    nmid = or_null(F.regexp_extract(n, r"\bID\s?(\d{13,15})\b", 1))
    terminal = F.coalesce(or_null(F.regexp_extract(n, r"\b(?:TID|TERMINAL)\s?:?\s?([A-Z0-9]{6,})\b", 1)), or_null(F.regexp_extract(n, r"\b(A0\d{6,})\b", 1)))
    number = or_null(F.regexp_extract(n, r"\b(\d{12,})\b", 1))
    acquirer = F.get(F.filter(literals(dims.ACQUIRERS), lambda a: F.contains(n, a)), 0)

    def telling(w: Column, acquirer: Column) -> Column:
        return (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~((F.length(w) > 5) & w.rlike(r"\d")) & ~w.eqNullSafe(acquirer) & ~among(w, dims.NOISE_WORDS)

    # the acquirer is found once, not for each word
    hint = or_null(F.array_join(let(acquirer, lambda a: F.filter(F.split(n, " "), lambda w: telling(w, a))), " "))
    return F.struct(
        F.concat(F.lit("ID"), nmid).alias("nmid"),
        or_null(F.regexp_extract(n, r"\b936\d{12,16}\b", 0)).alias("mpan"),
        terminal.alias("terminal_id"),
        F.when(~number.eqNullSafe(nmid), number).alias("reference"),
        acquirer.alias("acquirer"),
        hint.alias("name_hint"),
    )


def detect_kind(n: Column, direction: Column) -> Column:
    """Kind of transaction of normalised text n: a QRIS payment, else the first rule that fits text and direction."""
    out = F.when(is_qris(n), F.lit("qris"))
    for kind, pattern, needed in dims.KIND_RULES:
        fits = n.rlike(begun(pattern)) if needed is None else (direction == needed) & n.rlike(begun(pattern))
        out = out.when(fits, F.when(direction == "credit", "transfer_in").otherwise("transfer_out") if kind == "transfer" else F.lit(kind))
    return out.otherwise("other")


def tree_pattern(words: list[str]) -> str:
    """A regular expression for the longest of the words at a place: their letters as a tree, so that a place is left at the first
    letter that none of them goes on with."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [(c if c.isalnum() or c == " " else "\\" + c) + written(rest) for c, rest in node.items() if c]
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" if ways else ""
        return body + "?" if ways and "" in node else body

    return written(tree)


def places_pattern(words: list[str], most: int = 4) -> str:
    """tree_pattern, for places most of which begin none of the words: first letters are told apart by halves, down to a few, and
    these by the letters that come second. A row of alternatives is tried one by one at each place."""
    if not all(words):
        return tree_pattern(words)
    of = lambda letters: "[" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in letters) + "]"

    def told(letters: list[str]) -> str:
        mine = [w for w in words if w[0] in letters]
        if len(letters) <= most:
            second = of(sorted({w[1] for w in mine})) if all(len(w) > 1 for w in mine) else ""
            return f"(?={of(letters)}{second}){tree_pattern(mine)}"
        half = len(letters) // 2
        return f"(?:{'|'.join(f'(?={of(part)}){told(part)}' for part in (letters[:half], letters[half:]))})"

    return told(sorted({w[0] for w in words}))


def first_entry(n: Column, entries: list[list[str]]) -> Column:
    """The place, from 0, of the first of entries (lists of keywords) with a keyword anywhere in n, or null.

    At every place of n the tree of all keywords gives the longest one that begins there; the shorter ones that it begins with are
    there too, so it stands for the first entry of all of these. Only keywords that were found are looked up."""
    first: dict[str, int] = {}
    for i, keys in enumerate(entries):
        for k in keys:
            first.setdefault(k, i)
    best = {k: min(first[k[:j]] for j in range(1, len(k) + 1) if k[:j] in first) for k in first}
    keys, places = listed([*best]), listed([str(i) for i in best.values()]).cast("array<int>")
    found = F.array_distinct(F.regexp_extract_all(n, F.lit(f"(?=({places_pattern([*best])}))"), F.lit(1)))
    return F.array_min(F.transform(found, lambda k: F.get(places, F.array_position(keys, k).cast("int") - 1)))


def match_dictionary(n: Column, merchants: list[tuple[str, str, list[str]]] | None = None) -> Column:
    """The first merchant in list order with a keyword anywhere in n: struct(merchant, category), or null."""
    rows = merchants or dims.MERCHANTS
    names, categories = listed([m for m, _, _ in rows]), listed([c for _, c, _ in rows])
    entry = lambda at: F.when(at.isNotNull(), F.struct(F.get(names, at).alias("merchant"), F.get(categories, at).alias("category")))
    return let(first_entry(n, [keys for _, _, keys in rows]), entry)


def match_category_keyword(n: Column) -> Column:
    """The category of the first generic keyword in list order that n contains, or null."""
    return F.get(listed([c for c, _ in dims.CATEGORY_KEYWORDS]), first_entry(n, [keys for _, keys in dims.CATEGORY_KEYWORDS]))


def has_name_like_token(hint: Column) -> Column:
    return F.coalesce(hint.rlike(r"(^|\s)[A-Z]{3,}(\s|$)"), F.lit(False))


def title_case(s: Column) -> Column:
    """Each word capitalised; acronyms and words of one or two letters in upper case."""
    word = lambda w: F.when(among(F.upper(w), dims.ACRONYMS) | (F.length(w) <= 2), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), word), " ")


def fee_label(n: Column, fallback: Column) -> Column:
    """A name for a fee from its own normalised text: its first four words that tell something."""
    words = F.filter(F.split(n, " "), lambda w: w.rlike("^[A-Z]{2,}$") & ~among(w, dims.FEE_NOISE))
    return F.when(F.size(words) == 0, fallback).otherwise(title_case(F.array_join(F.slice(words, 1, 4), " ")))


def extract_counterparty(n: Column) -> Column:
    """The other party of a transfer: the longest run of plain words that are no stop words, the last one of equals."""
    marked = F.transform(F.split(n, " "), lambda w: F.when(w.rlike("^[A-Z]{2,}$") & ~among(w, dims.STOP_WORDS), w).otherwise(F.lit("|")))
    runs = F.filter(F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r)), lambda r: r != "")
    ranked = F.transform(runs, lambda r, i: F.struct(F.size(F.split(r, " ")).alias("words"), i.alias("at"), r.alias("name")))
    name = F.array_max(ranked)["name"]
    return F.when(F.length(name) >= 4, name)


def letters(s: Column) -> Column:
    return F.trim(spaced_out(F.upper(s), "A-Z"))


def merge_description(desc: Column, remark: Column) -> Column:
    """remark · desc, unless the remark's letters add nothing to desc."""

    def merged(p: Column) -> Column:
        d, r = p["d"], p["r"]
        told = let(F.struct(letters(d).alias("d"), letters(r).alias("r")), lambda own: (own["r"] == "") | F.contains(own["d"], own["r"]))
        return F.when(r == "", d).when(d == "", r).when(told, d).otherwise(F.concat(r, F.lit(" · "), d))

    return let(F.struct(F.trim(F.coalesce(desc, F.lit(""))).alias("d"), F.trim(F.coalesce(remark, F.lit(""))).alias("r")), merged)


def at_words(patterns: list[str]) -> list[str]:
    """Patterns of which any may fit, those whose alternatives all begin at the beginning or end of a word as one: of most places one look is enough."""
    words, others = [], []
    for p in patterns:
        own = ways(p.removeprefix("(?i)"))
        if p.startswith("(?i)") and all(w.startswith(r"\b") for w in own):
            words += own
        else:
            others.append(p)
    return [*others, *([rf"(?i)\b(?:{'|'.join(w[2:] for w in words)})"] if words else [])]


def is_statement_noise(line: Column, bank: Column | None = None) -> Column:
    """Whether a line of a statement is no transaction: page numbers, totals, headings, disclaimers."""
    out = F.lit(False)
    for p in at_words(dims.NOISE_LINES):
        out = out | line.rlike(p)
    if bank is not None:
        for name, p in dims.BANK_NOISE_LINES.items():
            out = out | ((bank == name) & line.rlike(p))
    return out


def needed(pattern: str) -> list[str]:
    """Letters, in lower case, that are in all a pattern matches: its runs of plain ones, the longest first. Patterns with groups,
    alternatives or rarer escapes have none."""
    plain = pattern.removeprefix("(?i)")
    if re.search(r"[|(\[{]|\\(?![bBsSdDwW]|\W)", plain):
        return []
    return sorted((w.lower() for w in re.findall(r"[A-Za-z]+(?![?*])", re.sub(r"\\.", " ", plain))), key=len, reverse=True)


def detect_bank(text: Column) -> Column:
    """struct(bank, label, confidence) by signatures in the first 6000 characters; the first of the best, generic without any.

    A signature is tried where the letters are that it cannot do without: most texts hold those of few, and to look for them is
    much less than to try a pattern at each place."""

    def scored(head: Column, lower: Column) -> Column:
        scores = []
        for at, (bank, label, signatures) in enumerate(dims.BANKS):
            score = F.lit(0)
            for pattern, weight in signatures:
                fits = reduce(lambda rest, w: F.contains(lower, F.lit(w)) & rest, reversed(needed(pattern)), head.rlike(pattern))
                score = score + F.when(fits, weight).otherwise(0)
            scores.append(F.struct(score.alias("score"), F.lit(-at).alias("order"), F.lit(bank).alias("bank"), F.lit(label).alias("label")))
        return F.array_max(F.array(*scores))

    def told(best: Column) -> Column:
        none = best["score"] == 0
        return F.struct(F.when(none, dims.GENERIC_BANK[0]).otherwise(best["bank"]).alias("bank"), F.when(none, dims.GENERIC_BANK[1]).otherwise(best["label"]).alias("label"), F.least(F.lit(1.0), best["score"] / 5.0).alias("confidence"))

    return let(F.substring(text, 1, 6000), lambda head: let(let(F.lower(head), lambda lower: scored(head, lower)), told))


def match_field(header: Column) -> Column:
    """The field that a column heading names: by the whole name, else by a whole word, else by a long name within it."""

    def best(h: Column) -> Column:
        def of(tokens: Column) -> Column:
            ranked = []
            for at, (field, names) in enumerate(dims.FIELD_NAMES):
                inside = F.exists(literals([n for n in names if len(n) >= 5]), lambda n: F.contains(h, n))
                score = F.when(h.isin(names), 3).when(F.arrays_overlap(tokens, literals(names)), 2).when(inside, 1).otherwise(0)
                ranked.append(F.struct(score.alias("score"), F.lit(-at).alias("order"), F.lit(field).alias("field")))
            found = let(F.array_max(F.array(*ranked)), lambda b: F.when(b["score"] > 0, b["field"]))
            return F.when((h != "") & ~F.arrays_overlap(tokens, literals(dims.REJECTED_TOKENS)), found)

        return let(F.split(h, " "), of)

    return let(F.trim(F.regexp_replace(F.regexp_replace(F.lower(header), "[^a-z0-9/ ]", " "), r"\s+", " ")), best)
