"""Artifact scanners: table generators over slices.

All of them decode a buffer once, cut it with one regular expression and compute offsets from the
lengths of the cuts, in a single Catalyst expression: no Python worker and no shuffle.

The e-mail scanners cut at each @ that is followed by a complete domain, found by look-ahead from
the @. That is far cheaper than trying the whole address at every byte, and gives the same
matches: an address holds one @ only, so each @ decides for itself which domain it has, and the
local part is the leftmost valid text before it that no earlier match has used.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import ANCHOR_DOMAIN, ANCHOR_LOCAL, AnchorPatterns, LexerPatterns
from ..functions.text import bind, context, latin1_bytes, narrow16, sql_literal
from .boundary import MARGIN, id_columns, own, windows
from .stitching import Within, runs, settled

_FOUND = "array<struct<pos:bigint,feature:string>>"
#: matches collected before they are joined with those found earlier
RUN = 64


def _cut(pattern: str) -> str:
    return f"split(decode(buffer, 'ISO-8859-1'), {sql_literal(pattern)}, -1)"


def _fold(count: str, step: str, state: dict[str, str]) -> str:
    """SQL that folds `step` over k = 0 .. count - 1 and gives all matches found.

    `step` maps (a, k) to a struct of the `state` fields and `found`, which it may append to.
    Appending copies an array, so matches are collected in runs of RUN and joined at the end;
    otherwise a slice full of addresses would cost the square of their number.
    """
    begin = ", ".join(f"'{name}', {value}" for name, value in state.items())
    resume = ", ".join(f"'{name}', o.{name}" for name in state)
    passed = ", ".join(f"'{name}', r.{name}" for name in state)
    run = (
        f"aggregate(sequence(b * {RUN}, least(b * {RUN} + {RUN - 1}, {count} - 1)), "
        f"named_struct({resume}, 'found', cast(array() as {_FOUND})), (a, k) -> {step})"
    )
    collected = bind(run, "r", f"named_struct({passed}, 'runs', concat(o.runs, array(r.found)))")
    return (
        f"flatten(aggregate(sequence(0, ({count} - 1) div {RUN}), "
        f"named_struct({begin}, 'runs', cast(array() as array<{_FOUND}>)), (o, b) -> {collected}).runs)"
    )


def _emit(slices: DataFrame, found: str, needle: Column | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (extra, ids, offset, feature, context) of an expression that finds matches in `buffer`.

    `extra` names further fields of a match. A match that reaches the end of a slice's context, beyond which the image
    goes on, may be longer than that and is an error; `Within` is for such.
    """
    ids = id_columns(slices)
    rows = windows(slices)
    if needle is not None:
        rows = rows.where(needle)
    # explode_outer: explode would evaluate the expression a second time in an inferred filter.
    hits = rows.select(
        *ids, "base", "buffer", "own_from", "own_to", F.explode_outer(F.expr(found)).alias("hit")
    ).where("hit is not null")
    feature = F.col("hit.feature")
    if "before" in slices.columns:
        reached = F.col("hit.pos") + F.length(feature) == F.length("buffer")
        ours = F.col("base") + F.col("hit.pos") < F.col("own_to")
        ahead, behind = F.col("own_from") - F.col("base"), F.col("base") + F.length("buffer") - F.col("own_to")
        # a context as wide as the one before the slice, or as wide as usual, is not the end of the image
        full = (behind > 0) & (behind >= F.when(ahead > 0, ahead).otherwise(F.lit(MARGIN)))
        cut = F.raise_error(F.lit("a match is longer than the context around its slice: scan its class with Within"))
        feature = F.when(reached & full & ours, cut.cast("string")).otherwise(feature)
    hits = hits.select(
        *[F.col(f"hit.{name}").alias(name) for name in extra],
        *ids,
        (F.col("base") + F.col("hit.pos")).alias("position"),
        "own_from",
        "own_to",
        feature.alias("feature"),
        context(F.col("buffer"), F.col("hit.pos"), F.length("hit.feature")).alias("context"),
    )
    return own(hits).select(*extra, *ids, F.col("position").alias("offset"), "feature", "context")


def _has_at() -> Column:
    return F.contains(F.col("buffer"), F.lit(b"@"))


def found_by_email(utf16: bool = True, tlds: Iterable[str] | None = None) -> str:
    """SQL for the addresses in `buffer` by the lexer rule: array of (pos, feature), NULL if none."""
    p = LexerPatterns(utf16, tlds)
    # p: text between anchors; anchor k lies between pieces k and k + 1. State: bytes up to piece k,
    # and bytes of piece k used by the last match. The next anchor itself may be the byte behind the
    # domain, hence the @ put back.
    tail = f"left(p[k + 1], {p.domain_bytes})"
    domain = f"regexp_extract(if(k + 2 < size(p), concat({tail}, '@'), {tail}), {sql_literal(p.domain)}, 0)"
    room = f"right(substring(p[k], a.used + 1), {p.LOCAL_BYTES})"
    local = (
        rf"regexp_extract(h.room, if(startswith(h.domain, char(0)), {sql_literal(p.LOCAL16)}, "
        rf"{sql_literal(p.LOCAL8)}), 0)"
    )
    at = "a.pos + length(p[k])"
    step = bind(
        f"struct({domain} as domain, {room} as room)",
        "h",
        bind(
            local,
            "l",
            f"named_struct('pos', {at} + 1, 'used', if(l = '', 0, length(h.domain)), "
            f"'found', if(l = '', a.found, concat(a.found, array(named_struct("
            f"'pos', {at} - length(l), 'feature', concat(l, '@', h.domain))))))",
        ),
    )
    matches = _fold("(size(p) - 1)", step, {"pos": "0L", "used": "0"})
    return bind(_cut(p.anchor), "p", f"if(size(p) < 2, null, {matches})")


def scan_email(slices: DataFrame, utf16: bool = True, tlds: Iterable[str] | None = None) -> DataFrame:
    """Addresses by the lexer rule: leftmost-longest and without overlap, 8-bit or UTF-16LE.

    A byte that is not a letter must follow, so an address at the very end of an image is not one.
    A UTF-16 feature keeps its NUL bytes.
    """
    return _emit(slices, found_by_email(utf16, tlds), _has_at())


def scan_email_anchor(
    slices: DataFrame,
    allow_space: bool = False,
    utf16: bool = True,
    tlds: Iterable[str] | None = None,
) -> DataFrame:
    """Addresses by the anchor rule: the maximal valid run on each side of an @.

    Results may overlap (`a@b.com@c.org` holds two). UTF-16 addresses are given as 8-bit text.
    """
    p = AnchorPatterns(allow_space, utf16, tlds)
    domain = f"regexp_extract(left(p[k + 1], {p.DOMAIN_BYTES}), {sql_literal(p.domain)}, 0)"
    local = (
        f"regexp_extract(right(p[k], {p.LOCAL_BYTES}), if(startswith(h, char(0)), "
        f"{sql_literal(p.local16)}, {sql_literal(p.local8)}), 0)"
    )
    at = "a.pos + length(p[k])"
    wide = "if(startswith(h, char(0)), 2, 1)"
    fits = (
        f"l <> '' and length(l) <= {ANCHOR_LOCAL} * {wide} and h <> '' "
        f"and length(h) <= {ANCHOR_DOMAIN} * {wide} + {wide} - 1"
    )
    step = bind(
        domain,
        "h",
        bind(
            local,
            "l",
            f"named_struct('pos', {at} + 1, 'found', if({fits}, concat(a.found, array(named_struct("
            f"'pos', {at} - length(l), 'feature', concat(l, '@', h)))), a.found))",
        ),
    )
    matches = _fold("(size(p) - 1)", step, {"pos": "0L"})
    found = bind(_cut(p.anchor), "p", f"if(size(p) < 2, null, {matches})")
    hits = _emit(slices, found, _has_at())
    return hits.withColumn("feature", narrow16(F.col("feature")))


def found_by_pattern(pattern: str) -> str:
    """SQL for the matches of `pattern` in `buffer`: array of (pos, feature), NULL if none."""
    rx = sql_literal(pattern)
    pair = f"struct(split(t, {rx}, -1) as gaps, regexp_extract_all(t, {rx}, 0) as hits)"
    # ends of the matches: sums of the lengths so far, by doubling, which costs far less than a fold that appends
    lengths = "zip_with(s.hits, slice(s.gaps, 1, size(s.hits)), (h, g) -> bigint(length(h) + length(g)))"
    shifted = "concat(array_repeat(0L, shiftleft(1, i)), slice(a, 1, size(a) - shiftleft(1, i)))"
    passes = "sequence(0, greatest(int(ceil(log2(size(s.hits)))) - 1, 0))"
    ends = f"aggregate({passes}, {lengths}, (a, i) -> zip_with(a, {shifted}, (x, y) -> x + y))"
    found = f"zip_with(s.hits, {ends}, (h, e) -> named_struct('pos', e - length(h), 'feature', h))"
    return bind(
        "decode(buffer, 'ISO-8859-1')",
        "t",
        f"if(t rlike {rx}, {bind(pair, 's', found)}, null)",
    )


def scan_pattern(slices: DataFrame, pattern: str | Within) -> DataFrame:
    """Matches of any regular expression over the Latin-1 text, leftmost and without overlap.

    A match may be as long as the context around the slices (a longer one is an error), or of any length where the
    pattern is given as `Within`. The pattern must not match the empty text.
    """
    if isinstance(pattern, Within):
        return scan(slices, {"": pattern}).drop("artifact_class")
    return _emit(slices, found_by_pattern(pattern), None)


def scan(slices: DataFrame, patterns: Mapping[str, str | Within | None] | None = None) -> DataFrame:
    """Matches of the selected scanners with their `artifact_class`; one pass, whatever their number.

    A class given as None uses the built-in rule; "email" is the only such class. A class given as `Within` has matches
    of any length: what reaches the edges of a slice is stitched together, from a second, light pass over the slices.
    """
    patterns = patterns or {"email": None}
    rules = {name: p for name, p in patterns.items() if isinstance(p, Within)}
    if rules and "own_from" in slices.columns:
        raise ValueError("seams and Within both join slices: give the slices themselves")
    classes = []
    for name, pattern in patterns.items():
        if isinstance(pattern, Within):
            found = settled(found_by_pattern(pattern.pattern), pattern)
        elif pattern is not None:
            found = found_by_pattern(pattern)
        elif name == "email":
            found = f"if(contains(buffer, X'40'), {found_by_email()}, null)"
        else:
            raise ValueError(f"no built-in scanner for {name!r}")
        match = f"named_struct('artifact_class', {sql_literal(name)}, 'pos', m.pos, 'feature', m.feature)"
        classes.append(f"transform({found}, m -> {match})")
    every = f"flatten(filter(array({', '.join(classes)}), c -> c is not null))"
    hits = _emit(slices, every, None, ("artifact_class",))
    if not rules:
        return hits
    whens = " ".join(f"when {sql_literal(n)} then {found_by_pattern(r.pattern)}" for n, r in rules.items())
    stitched = _emit(runs(slices, rules), f"case artifact_class {whens} end", None)
    return hits.unionByName(stitched)


def to_artifacts(features: DataFrame, artifact_class: str | None = None) -> DataFrame:
    """Features as rows of the artifact table."""
    cls = F.lit(artifact_class) if artifact_class is not None else F.col("artifact_class")
    prefix = F.col("recursion_prefix") if "recursion_prefix" in features.columns else F.lit("")
    return features.select(
        cls.alias("artifact_class"),
        F.col("image").alias("stream_name"),
        prefix.alias("recursion_prefix"),
        "offset",
        latin1_bytes(F.col("feature")).alias("artifact"),
    )
