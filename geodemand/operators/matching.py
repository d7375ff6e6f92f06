"""Fuzzy and cascaded entity matching.

``similarity_join`` finds, for every left row, the best right row whose
similarity score reaches a threshold -- exactly, without comparing all pairs of
a block:

1. It works on the distinct (block, form) of each side, a form being what the
   score depends on (sorted tokens, say). A right form keeps its first row.
2. Levels from 100 down to the threshold: what has a best match at a level is
   done, since every pair at or above the level was found, so the wide search at
   the threshold meets only texts without a good match.
3. Candidates by prefix filtering, tokens ordered rare first over all texts. For
   Indel similarity ``2*LCS/(la+lb) >= t`` an LCS alignment keeps at least
   ``3*LCS - la - lb - 1`` bigrams of one text intact in the other, hence
   ``ceil((1.5t - 1)(la + la*t/(2-t)) - 1)`` for any admissible partner; two texts
   that share so many share one of their first ``|bigrams| - bound + 1``. Texts
   without a bound of one, and what may pair with them, meet by characters in
   the same way. Pairs whose lengths, common bigrams or common characters rule
   the score out are dropped before they are scored.
   Texts of lengths that leave few characters unmatched meet by short sequences
   instead: an alignment of ``common = ceil(t * (la+lb) / 2)`` characters has its
   ``k`` rarest (ties by place) among the first ``l - common + k`` of either text, and
   in the same order in both. They are made for each length that a partner has.
   Token-set scores do not depend on the order of the words. Where the whole texts
   decide without a shared word, sequences serve as above; with one, the characters in
   common, repeats counted, are as many, so the texts have a shared word and a set of
   ``k`` rare characters in common (lengths that leave many unmatched: such a set alone). Where the shared words decide, they make up
   ``t/(2-t)`` of one side, so one of that side's rarest words, up to where the rest
   falls short of it, is among the other's words.
4. Native scores on candidates only, then the best partner by (score
   descending, right order ascending).
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.functions.text import chars, indel_ratio, match_masks, sort_tokens, token_set_ratio_of, tokens
from geodemand.operators.rows import spread

_FORM = ("_side", "_blk", "_form")
_KEYS = 128  # sequences of rare characters that a text has for one length of a partner, about
_SPARE = 7   # characters left unmatched up to which sequences take the place of bigrams
_SPARE_WORDS = 5  # and that of sets of characters alone


def _bigram_bound(n: int, t: float) -> int:
    if t <= 2.0 / 3.0:
        return 0
    return math.ceil((1.5 * t - 1.0) * (n + n * t / (2.0 - t)) - 1.0 - 1e-9)


def _grams(x: Column, q: int) -> Column:
    n = F.length(x)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(x, i, q))).otherwise(
        F.array().cast("array<string>"))


def _numbered(x: Column) -> Column:
    """A text's characters, equal ones told apart by a number."""
    return F.transform(F.array(F.array_sort(x)), lambda y: F.transform(
        y, lambda ch, i: F.concat(ch, (i - F.array_position(y, ch)).cast("string"))))[0]


def _token_arrays(forms: DataFrame, by_word: bool) -> DataFrame:
    """Forms with their bigrams (``b``), characters (``u``) and words (``w``) as (frequency, token), rare first.

    Equal bigrams and characters of a text are told apart by their number. What
    pairs are filtered and scored by is computed here, once for each form.
    """
    form = F.col("_form")
    words = tokens(form) if by_word else F.array().cast("array<string>")
    bigrams = F.flatten(F.transform(words, lambda w: _grams(w, 2))) if by_word else _grams(form, 2)
    forms = spread(forms, *_FORM).withColumns({"words": words, "bigrams": bigrams, "letters": _numbered(chars(form)), "masks": match_masks(form)})
    kinds = {"b": F.col("bigrams"), "u": chars(form), "w": F.col("words")}

    def tag(kind: str, x: Column) -> Column:
        return F.transform(x, lambda y: F.struct(F.lit(kind).alias("kind"), y.alias("tok")))

    tagged = [tag(kind, x) for kind, x in kinds.items()]
    long = forms.select(*_FORM, F.explode(F.flatten(F.array(*tagged))).alias("e")).select(*_FORM, "e.*")
    long = long.groupBy(*_FORM, "kind", "tok").agg(F.count(F.lit(1)).alias("n"))
    long = long.select(*_FORM, "kind", F.col("tok").alias("_raw"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select(
        *_FORM, "kind", "_raw", F.concat_ws("#", "_raw", "k").alias("tok"))
    often = long.groupBy("kind", "tok").agg(F.count(F.lit(1)).alias("f"), (F.min("_side") != F.max("_side")).alias("both"))
    rare_first = F.struct("f", "tok", F.length("_raw").alias("len"), "both")
    packed = long.join(often, ["kind", "tok"]).groupBy(*_FORM).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, rare_first))).alias(k) for k in "buw"])
    forms = forms.withColumn("repeats", F.size("bigrams") - F.size(F.array_distinct("bigrams"))).withColumn("bigrams", F.array_distinct("bigrams"))
    # the packed texts are many times their shuffled size: never sent whole to the driver
    return forms.join(packed.hint("merge"), list(_FORM), "left").withColumns(
        {k: F.coalesce(k, F.array().cast("array<struct<f:bigint,tok:string,len:int,both:boolean>>")) for k in "buw"})


def _first(name: str, count: Column) -> Column:
    return F.transform(F.slice(name, F.lit(1), F.greatest(count, F.lit(0)).cast("int")), lambda x: F.concat(F.lit(f"{name}:"), x["tok"]))


def _spread(df: DataFrame, name: str, keys: Column) -> DataFrame:
    return df.select("_blk", F.col("_form").alias(name), F.explode(keys).alias("tok"))


def _meet(left: DataFrame, right: DataFrame, routes: list[tuple[Column, Column]]) -> DataFrame:
    """(_blk, _lf, _rf) of the forms that share a key on one of the routes, repeats included."""
    pairs = None
    for of_left, of_right in routes:
        met = _spread(left, "_lf", of_left).join(_spread(right, "_rf", of_right).hint("merge"), ["_blk", "tok"]).select("_blk", "_lf", "_rf")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


_TAKEN = [max(k for k in range(1, _KEYS) if k == 1 or math.comb(spare + k, spare) <= _KEYS) for spare in range(15)]  # 1 for more


class _Lengths:
    """The lengths of the texts that are there, a short list for each side, and what pairs of them have in common at ``t``."""

    def __init__(self, left: DataFrame, right: DataFrame, t: float, most_spare: int):
        self.t, self.most_spare = t, most_spare
        self.left, self.right = (sorted(r[0] for r in df.select(F.length("_form")).distinct().collect()) for df in (left, right))

    def beyond(self) -> tuple[list[int], list[int]]:
        """Lengths of left and of right texts with a partner that leaves more than ``most_spare`` characters unmatched."""
        found: tuple[set[int], set[int]] = (set(), set())
        for n in self.left:
            reach = (bisect.bisect_left(self.right, n * self.t / (2.0 - self.t) - 1e-9), bisect.bisect_right(self.right, n * (2.0 - self.t) / self.t + 1e-9))
            for m in self.right[slice(*reach)]:
                if max(n, m) - math.ceil(self.t * (n + m) / 2.0 - 1e-9) > self.most_spare:
                    found[0].add(n)
                    found[1].add(m)
        return sorted(found[0]), sorted(found[1])

    def plan(self, is_left: bool, few: bool) -> Column:
        """Per text, for each length of a partner (``m``) that leaves up to ``most_spare`` unmatched (``few``) or more: how many of its characters are left out (``out``), how many rare ones are taken (``k``)."""
        n, t = F.length("_form"), self.t
        there = F.array(*[F.lit(m) for m in (self.right if is_left else self.left)]).cast("array<int>")
        partners = F.sequence(F.greatest(F.lit(1), F.ceil(n * F.lit(t / (2.0 - t)) - F.lit(1e-9))).cast("int"),
                              F.greatest(F.lit(1), F.floor(n * F.lit((2.0 - t) / t) + F.lit(1e-9))).cast("int"))

        def entry(m: Column) -> Column:
            common = F.ceil(F.lit(t) * (n + m) / 2.0 - F.lit(1e-9)).cast("int")
            return F.struct(m.alias("m"), common.alias("common"), (F.greatest(n, m) - common).alias("spare"), F.least(n, m).alias("least"))

        def use(p: Column) -> Column:
            taken = F.coalesce(F.get(F.array(*[F.lit(k) for k in _TAKEN]), p["spare"]), F.lit(1))
            taken = F.when(p["spare"] == 0, p["common"]).otherwise(F.least(p["common"], taken))
            return F.struct(p["m"].alias("m"), (n - p["common"]).alias("out"), taken.alias("k"))

        def within(p: Column) -> Column:
            return (p["common"] >= 1) & (p["least"] >= p["common"]) & ((p["spare"] <= self.most_spare) == F.lit(few))

        return F.transform(F.filter(F.transform(F.array_intersect(partners, there), entry), within), use)


def _chosen(items: Column, k: Column, out: Column, seed: Column) -> Column:
    """Hashes of all choices of ``k`` of the ``k + out`` items, in their order."""
    first = F.array(F.struct(seed.alias("h"), F.lit(0).alias("taken"), F.lit(0).alias("passed")))

    def step(state: Column, x: Column) -> Column:
        take = F.transform(F.filter(state, lambda s: s["taken"] < k), lambda s: F.struct(
            F.xxhash64(s["h"], x).alias("h"), (s["taken"] + 1).alias("taken"), s["passed"].alias("passed")))
        leave = F.transform(F.filter(state, lambda s: s["passed"] < out), lambda s: F.struct(
            s["h"].alias("h"), s["taken"].alias("taken"), (s["passed"] + 1).alias("passed")))
        return F.concat(take, leave)

    return F.transform(F.aggregate(items, first, step), lambda s: s["h"])


def _rare_keys(lengths: _Lengths, is_left: bool, in_order: bool, few: bool = True) -> Column:
    """A form's hashed choices of its rare characters, for each length that a partner has.

    With ``common`` characters matched, the ``k`` rarest matched ones stand among the
    first ``length - common + k`` of either text. Both texts take the same ``k``, from
    their two lengths. ``in_order``: as they follow each other in the text; else as a
    set. Equal hashes of different choices only add a pair that is scored.
    """
    n = F.length("_form")

    def keys(p: Column) -> Column:
        items = F.slice("rare", F.lit(1), p["out"] + p["k"])
        if in_order:
            items = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["at"], x["ch"]))), lambda x: x["ch"])
        return F.array_distinct(_chosen(items, p["k"], p["out"], F.xxhash64(n, p["m"]) if is_left else F.xxhash64(p["m"], n)))

    return F.flatten(F.transform(lengths.plan(is_left, few), keys))


def _placed(df: DataFrame) -> DataFrame:
    """``df`` with its characters and their places (``rare``), rare first; equal ones by place."""
    # the first of equal characters bears the number 1 and the frequency of the character
    often = F.map_from_entries(F.transform(F.filter("u", lambda x: x["tok"].endswith("#1")), lambda x: F.struct(
        F.substring(x["tok"], 1, 1).alias("ch"), x["f"].alias("f"))))
    return df.withColumn("rare", F.transform(F.array(often), lambda f: F.array_sort(F.transform(chars("_form"), lambda ch, i: F.struct(
        F.element_at(f, ch).alias("f"), ch.alias("ch"), i.alias("at")))))[0])


def _by_grams(left: DataFrame, right: DataFrame, t: float, bound: Column) -> DataFrame:
    """Pairs by sequences of rare characters; those of lengths that leave many unmatched by rare bigrams.

    Rare characters take the place of bigrams where a text has no bound on them, and for what may pair with it.
    """
    lengths = _Lengths(left, right, t, _SPARE)
    placed_l, placed_r = _placed(left), _placed(right)
    pairs = _meet(placed_l, placed_r, [(_rare_keys(lengths, True, True), _rare_keys(lengths, False, True))])
    n = F.length("_form")
    beyond = lengths.beyond()
    if not beyond[0]:
        return pairs
    left, right = (df.where(n.isin(ls)) for df, ls in zip((left, right), beyond))
    strong = bound >= 1
    weakest = left.unionByName(right).agg(F.max(F.when(~strong, n))).first()[0]
    reach = -1 if weakest is None else max(weakest, math.floor(weakest * (2.0 - t) / t + 1e-9))
    common = F.ceil(F.lit(t) * (n + n * F.lit(t / (2.0 - t))) / 2.0 - 1e-9)
    none = F.array().cast("array<string>")
    keys = F.concat(F.when(strong, _first("b", F.size("b") - bound + 1)).otherwise(none),
                    F.when(n <= reach, _first("u", F.greatest(F.size("u") - common + 1, F.lit(1)))).otherwise(none))
    nl, nr = F.length("_lf"), F.length("_rf")
    return pairs.unionByName(_meet(left, right, [(keys, keys)]).where(2 * F.least(nl, nr) >= F.lit(t) * (nl + nr) - F.lit(1e-9)))


def _by_words(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Pairs whose shared words decide, and (below 100) pairs by rare characters."""
    rest = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.aggregate(
        F.slice("w", i, F.size("w")), F.lit(-1), lambda acc, x: acc + x["len"] + 1))
    decisive = F.size(F.filter(rest, lambda r: r >= F.length("_form") * F.lit(t / (2.0 - t)) - F.lit(1e-9)))
    some, every = _first("w", decisive), _first("w", F.size("w"))
    pairs = _meet(left, right, [(some, every), (every, some)])
    if t >= 1.0:  # only containment scores 100
        return pairs
    lengths = _Lengths(left, right, t, _SPARE_WORDS)
    placed_l, placed_r = _placed(left), _placed(right)
    pairs = pairs.unionByName(_meet(placed_l, placed_r, [(_rare_keys(lengths, True, True), _rare_keys(lengths, False, True))]))
    letters = F.transform("u", lambda x: x["tok"])
    if lengths.beyond()[0]:
        pairs = pairs.unionByName(_meet(left.withColumn("rare", letters), right.withColumn("rare", letters),
                                        [(_rare_keys(lengths, True, False, False), _rare_keys(lengths, False, False, False))]))
    shared = F.transform(F.filter("w", lambda x: x["both"]), lambda x: x["tok"])

    def with_word(df: DataFrame, is_left: bool) -> DataFrame:
        df = df.where(F.size(shared) > 0).withColumn("rare", letters)
        return df.withColumn("keys", _rare_keys(lengths, is_left, False)).withColumn("word", F.explode(shared))

    worded = F.transform("keys", lambda h: F.xxhash64(h, "word"))
    return pairs.unionByName(_meet(with_word(left, True), with_word(right, False), [(worded, worded)]))


def _candidates(left: DataFrame, right: DataFrame, t: float, by_word: bool) -> DataFrame:
    """Distinct (_blk, _lf, _rf) of all pairs that may reach ``t``, with both forms' words and the left one's masks."""
    n = F.length("_form")
    bound = F.lit(0)
    if t > 2.0 / 3.0:
        bound = F.ceil(F.lit(1.5 * t - 1.0) * (n + n * F.lit(t / (2.0 - t))) - F.lit(1.0 + 1e-9))
        if by_word:  # bigrams are those within words: two less for each gap
            bound = bound - 2 * (F.size("words") - 1)
    nl, nr = F.length("_lf"), F.length("_rf")
    own = ["words", "bigrams", "repeats", "letters", "masks", "bound"]
    pairs = (_by_words(left, right, t) if by_word else _by_grams(left, right, t, bound)).distinct()
    for df, form, tag in ((left, "_lf", "l_"), (right, "_rf", "r_")):
        facts = df.withColumn("bound", bound).select("_blk", F.col("_form").alias(form), *[F.col(c).alias(tag + c) for c in own])
        pairs = pairs.join(facts.hint("merge"), ["_blk", form])
    out = ["_blk", "_lf", "_rf", "l_words", "r_words", "l_masks"]
    if t >= 1.0 and by_word:
        return pairs.select(out)
    # bigrams in common, at most: distinct ones and the repeats of either text
    shared = F.size(F.array_intersect("l_bigrams", "r_bigrams")) + F.least("l_repeats", "r_repeats")
    likely = (F.least("l_bound", "r_bound") < 1) | (shared >= F.greatest("l_bound", "r_bound"))
    alike = F.size(F.array_intersect("l_letters", "r_letters"))
    likely = likely & (2 * alike >= F.lit(t) * (nl + nr) - F.lit(1e-9))
    if by_word:
        words_shared = F.length(F.array_join(F.array_intersect("l_words", "r_words"), " "))
        likely = likely | (words_shared >= F.least(nl, nr) * F.lit(t / (2.0 - t)) - F.lit(1e-9))
    return pairs.where(likely).select(out)


def similarity_join(left: DataFrame, right: DataFrame, *, left_id: str, left_text: str, right_id: str,
                    right_text: str, threshold: float, scorer: str = "token_sort",
                    block: tuple[str, str] | None = None, right_order: str | None = None) -> DataFrame:
    """Best right match per left row with score >= threshold (0-100).

    Returns ``left_id, right_id, score``; left rows without a match are absent.
    ``scorer`` is ``ratio``, ``token_sort`` or ``token_set``. ``block`` = (left
    column, right column) that must be equal (NULL never matches). Ties on score
    go to the smallest ``right_order`` (default: right id).
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    by_word = scorer == "token_set"
    form = {"ratio": lambda c: F.col(c), "token_sort": sort_tokens,
            "token_set": lambda c: F.array_join(F.array_sort(F.array_distinct(tokens(c))), " ")}[scorer]
    lb, rb = block if block else (None, None)

    def known(df: DataFrame, key: str | None, text: str, *more: Column) -> DataFrame:
        blk = F.col(key) if key else F.lit(0)
        return df.select(*more, blk.alias("_blk"), form(text).alias("_form")).where("_blk is not null and _form is not null")

    rows = known(left, lb, left_text, F.col(left_id))
    entries = known(right, rb, right_text, F.col(right_id).alias("_rid"), F.col(right_order or right_id).alias("_ord"))
    entries = entries.groupBy("_blk", "_form").agg(F.min_by("_rid", F.struct("_ord", "_rid")).alias("_rid"), F.min("_ord").alias("_ord"))
    if by_word:  # a blank text scores 0 against any
        rows, entries = rows.where("_form != ''"), entries.where("_form != ''")
    entries = entries.checkpoint()
    pending = rows.select("_blk", "_form").distinct().checkpoint()
    found: list[DataFrame] = []

    def settle(scored: DataFrame) -> None:
        nonlocal pending
        best = F.min_by(F.struct(F.col("_rid"), F.col("score")), F.struct(-F.col("score"), F.col("_ord"), F.col("_rid")))
        done = scored.groupBy("_blk", "_form").agg(best.alias("_b")).select("_blk", "_form", "_b.*").checkpoint()
        found.append(done)
        pending = pending.join(done, ["_blk", "_form"], "left_anti").checkpoint()

    if not by_word:
        settle(pending.join(entries, ["_blk", "_form"]).withColumn("score", F.lit(100.0)))
    if not pending.isEmpty():
        forms = pending.withColumn("_side", F.lit("L")).unionByName(entries.select("_blk", "_form").withColumn("_side", F.lit("R")))
        arrays = _token_arrays(forms.select(*_FORM), by_word).checkpoint()
        levels = sorted({(100.0 + threshold) / 2, float(threshold), *([100.0] if by_word else [])}, reverse=True)
        for level in levels:
            here = arrays.where("_side = 'L'").join(pending, ["_blk", "_form"], "left_semi")
            pairs = _candidates(here, arrays.where("_side = 'R'"), level / 100.0, by_word)
            score = token_set_ratio_of(F.col("l_words"), F.col("r_words")) if by_word else indel_ratio("_lf", "_rf", F.col("l_masks"))
            scored = spread(pairs).select("_blk", F.col("_lf").alias("_form"), "_rf", score.alias("score")).where(F.col("score") >= level)
            settle(scored.join(entries.withColumnRenamed("_form", "_rf"), ["_blk", "_rf"]))
            if pending.isEmpty():
                break
    matches = found[0]
    for more in found[1:]:
        matches = matches.unionByName(more)
    return rows.join(matches, ["_blk", "_form"]).select(left_id, F.col("_rid").alias(right_id), "score")


def cascade(left: DataFrame, left_id: str, tiers: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]],
            match_col: str = "match_id", method_col: str = "match_method",
            unmatched: str = "unmatched") -> DataFrame:
    """Tiered matching with provenance.

    Each tier is (name, fn) where ``fn(pending)`` returns ``left_id, match_col,
    method_col`` for the rows it resolves (``match_col`` may be NULL for a
    terminal verdict such as 'no candidates'). A tier only sees rows no earlier
    tier resolved (``left_anti``); the rest get ``unmatched``.
    """
    pending = left
    parts = []
    for _, fn in tiers:
        # Each tier's verdicts are written once (shared checkpoint folder): the next tier's
        # anti join and the final union read them instead of recomputing the tier.
        res = fn(pending).select(left_id, match_col, method_col).checkpoint()
        parts.append(res)
        pending = pending.join(res.select(left_id), left_id, "left_anti")
    rest = pending.select(left_id, F.lit(None).cast(parts[0].schema[match_col].dataType).alias(match_col),
                          F.lit(unmatched).alias(method_col))
    out = rest
    for p in parts:
        out = out.unionByName(p)
    return out
