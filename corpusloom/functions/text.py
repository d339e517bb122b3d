"""Scalar functions on text, as Column expressions: everything stays in the JVM.

Regular expressions are Unicode-aware throughout. ``WS`` is white space as scripts that
split on it understand it, control separators included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TSHEG, SHAD, NYIS_SHAD, NGA = "་", "།", "༎", "ང"
GA_KA = ("ག", "ཀ")
#: Sentence-final question particles.
QUESTION_PARTICLES = ("ག", "སྨོ", "ན", "ཨིན་ན")
#: Proper nouns that a lower-cased corpus gets back; each maps to itself with a capital.
GAZETTEER = (
    "i bhutan bhutanese thimphu paro punakha wangdue trongsa bumthang trashigang samdrup jongkhar gelephu phuentsholing haa dagana tsirang zhemgang lhuentse "
    "mongar pemagatshel samtse chukha gasa druk dzongkha india indian nepal nepali china chinese tibet tibetan japan japanese america american england english "
    "britain british france french germany german korea korean thailand bangladesh buddha buddhism buddhist monday tuesday wednesday thursday friday saturday "
    "sunday january february march april may june july august september october november december"
).split()
TIBETAN_BLOCK = r"\x{0F00}-\x{0FFF}"
TIBETAN_DIGITS, ASCII_DIGITS = "༠༡༢༣༤༥༦༧༨༩", "0123456789"
_WS = r"\s\x1c-\x1f"
WS = rf"(?U)[{_WS}]"
#: What may stand before a sentence without being part of it (spaces, pipes, head marks, dashes, bullets, points).
_JUNK = r"|༉༄༅༆༇࿐࿑\-–—•·:;,."
JUNK_AT_ENDS = rf"(?U)^[{_WS}{_JUNK}]+|[{_WS}|]+\z"
#: White space that isn't one plain space.
WS_RUN = rf"(?U)[{_WS}]{{2,}}|[{_WS}&&[^ ]]"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once: inside a lambda it would be computed anew for each element."""
    return F.element_at(F.transform(F.array(x), use), 1)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)^[{_WS}]+|[{_WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, WS_RUN, " "))


def chunks(c: Column) -> Column:
    """Pieces between white space, none of them empty."""
    return F.filter(F.split(c, rf"{WS}+"), lambda x: x != "")


def space_chunks(c: Column) -> Column:
    """Pieces between plain spaces, none of them empty."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def tail_syllable(c: Column) -> Column:
    """The last non-empty piece between tshegs, else the empty string."""
    return F.coalesce(F.try_element_at(F.filter(F.split(c, TSHEG), lambda x: x != ""), F.lit(-1)), F.lit(""))


def rstrip_shad(c: Column) -> Column:
    return F.regexp_replace(c, f"{SHAD}+$", "")


def _last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def _markers(markers: Sequence[str] | Column) -> Column:
    return markers if isinstance(markers, Column) else F.array(*[F.lit(m) for m in markers]).cast("array<string>")


def dz_normalize(c: Column, markers: Sequence[str] | Column = (), shad_after_ga: bool = True, idempotent: bool = False) -> Column:
    """Dzongkha with its shads and phrase spaces restored.

    A token that lacks its tsheg lost a shad; a space stays only there and after a marker.
    A token that ends in a shad gets a second one, as upstream has it; ``idempotent`` keeps
    such tokens as they are.
    """
    known = _markers(markers)

    def restore(tok: Column, i: Column, n: Column) -> Column:
        gap = F.when(i < n - 1, " ").otherwise("")
        whole = F.when(tok.endswith(NGA), F.concat(tok, F.lit(TSHEG + SHAD)))
        if idempotent:
            whole = F.when(tok.endswith(SHAD), tok).when(tok.endswith(NGA), F.concat(tok, F.lit(TSHEG + SHAD)))
        if not shad_after_ga:
            whole = whole.when(F.right(tok, F.lit(1)).isin(*GA_KA), tok)
        whole = whole.otherwise(F.concat(tok, F.lit(SHAD)))
        phrase = F.when(F.array_contains(known, tail_syllable(tok)), gap).otherwise("")
        return F.when(tok.endswith(TSHEG), F.concat(tok, phrase)).otherwise(F.concat(whole, gap))

    def end(body: Column) -> Column:
        bare = F.regexp_replace(body, f"{TSHEG}$", "")
        return F.when(body.endswith(SHAD), body).when(bare.endswith(NGA), F.concat(bare, F.lit(TSHEG + SHAD))).otherwise(F.concat(bare, F.lit(SHAD)))

    def whole(tokens: Column) -> Column:
        body = let(F.size(tokens), lambda n: F.array_join(F.transform(tokens, lambda t, i: restore(t, i, n)), ""))
        return F.when(F.size(tokens) == 0, "").otherwise(squeeze(let(body, end)))

    return F.when(c.isNotNull(), let(chunks(c), whole))


def respace(c: Column, markers: Sequence[str] | Column) -> Column:
    """Spaces kept only after a chunk whose tail, shads aside, is a marker."""
    known = _markers(markers)

    def keep(x: Column, i: Column, n: Column) -> Column:
        return F.when((i < n - 1) & F.array_contains(known, tail_syllable(rstrip_shad(x))), F.concat(x, F.lit(" "))).otherwise(x)

    return let(space_chunks(c), lambda parts: let(F.size(parts), lambda n: F.array_join(F.transform(parts, lambda x, i: keep(x, i, n)), "")))


def en_normalize(c: Column, is_question: Column | None = None) -> Column:
    """English with commas (a run of white space), proper nouns, capitals and the final mark restored."""
    names = F.create_map(*[F.lit(x) for w in GAZETTEER for x in (w, w.capitalize())])
    s = F.regexp_replace(strip(c), rf"{WS}{{2,}}", ", ")
    s = F.array_join(F.transform(F.split(s, " "), lambda w: F.coalesce(F.try_element_at(names, w), w)), " ")
    # No two white spaces are left side by side, so a sentence starts one character after its mark.
    first = F.transform(
        F.split(s, rf"(?U)(?<=[.!?][{_WS}])"), lambda p: F.when(F.left(p, F.lit(1)).rlike("^[a-z]"), F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1_000_000_000))).otherwise(p)
    )
    s = F.array_join(first, "")
    mark = F.lit(".") if is_question is None else F.when(is_question, "?").otherwise(".")
    return F.when(strip(c) == "", "").when(s.rlike(r"[.!?]\z"), s).otherwise(F.concat(s, mark))


def is_dz_question(c: Column) -> Column:
    """Whether the last raw token is a question particle."""
    return F.coalesce(_last(chunks(c)).isin(*QUESTION_PARTICLES), F.lit(False))


def normalize_pair(dz: Column, en: Column, markers: Sequence[str] | Column = (), shad_after_ga: bool = True) -> Column:
    """Struct (dz, en) of both sides normalised; the raw Dzongkha decides what the English ends in."""
    return F.struct(dz_normalize(dz, markers, shad_after_ga).alias("dz"), en_normalize(en, is_dz_question(dz)).alias("en"))


def host_of(url: Column) -> Column:
    """The lower-cased third piece between slashes, port and user included; empty without a scheme."""
    return F.when(F.instr(url, "://") > 0, F.lower(F.coalesce(F.try_element_at(F.split(url, "/"), F.lit(3)), F.lit("")))).otherwise("")


def clean_sentence(c: Column) -> Column:
    """Without pipes, marks before and white space around; runs of white space as one space."""
    s = F.regexp_replace(F.translate(c, "|", " "), JUNK_AT_ENDS, "")
    return F.regexp_replace(s, WS_RUN, " ")


def spaces_per_syllable(c: Column) -> Column:
    """Plain spaces for each tsheg; 0 without one."""
    return F.coalesce(F.try_divide(count_of(c, " ").cast("double"), count_of(c, TSHEG)), F.lit(0.0))


def script_ratio(c: Column, block: str = TIBETAN_BLOCK) -> Column:
    """Share of the characters other than white space that belong to ``block``; 0 if there are none."""
    own = F.length(F.regexp_replace(c, f"[^{block}]", "")).cast("double")
    rest = F.length(F.regexp_replace(c, WS, ""))
    return F.coalesce(F.try_divide(own, rest), F.lit(0.0))


def digits_in(c: Column) -> Column:
    """The distinct numbers of a text, Tibetan digits as ASCII ones, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(c, TIBETAN_DIGITS, ASCII_DIGITS), F.lit(r"(?U)\d+"), F.lit(0))))


def digit_conflict(dz: Column, en: Column) -> Column:
    """Whether the English states numbers, and others than the Dzongkha."""
    return (F.size(digits_in(en)) > 0) & (digits_in(en) != digits_in(dz))


def _draw(num: Column, key: Column) -> Column:
    """A number of as many digits, set by the key and the number alone; no leading zero unless it has one digit."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(num) - 1) / 15).cast("int")), lambda i: _draw_part(num, key, i))
    return F.array_join(parts, "")


def _draw_part(num: Column, key: Column, i: Column) -> Column:
    size = F.least(F.length(num) - i * 15, F.lit(15))
    low = F.when((i == 0) & (size > 1), _power10(size - 1)).otherwise(F.lit(0).cast("bigint"))
    drawn = F.conv(F.left(F.md5(F.concat_ws("|", key, num, i.cast("string"))), F.lit(15)), 16, 10).cast("bigint")
    return F.lpad((low + F.pmod(drawn, _power10(size) - low)).cast("string"), size, F.lit("0"))


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def substitute_digits(dz: Column, en: Column, key: Column) -> Column:
    """Struct (dz, en) with every number of an aligned pair replaced on both sides at once; null where that fails.

    A number's replacement is set by ``key`` and the number, so no replacement is replaced again. Each number must occur
    on both sides, on the first in Tibetan digits, and must change.
    """
    tibetan = F.regexp_extract_all(dz, F.lit("[༠-༩]+|[^༠-༩]+"), F.lit(0))
    english = F.regexp_extract_all(en, F.lit(r"(?U)\d+|\D+"), F.lit(0))

    def whole(numbers: Column) -> Column:
        there = F.transform(F.filter(tibetan, lambda p: p.rlike("^[༠-༩]")), lambda p: F.translate(p, TIBETAN_DIGITS, ASCII_DIGITS))
        ok = (F.size(numbers) > 0) & (numbers == digits_in(en)) & (F.size(F.array_except(numbers, there)) == 0) & F.forall(numbers, lambda n: _draw(n, key) != n)

        def put(pieces: Column, back: bool) -> Column:
            def one(p: Column) -> Column:
                n = F.translate(p, TIBETAN_DIGITS, ASCII_DIGITS)
                new = let(n, lambda x: _draw(x, key))
                return F.when(F.array_contains(numbers, n), F.translate(new, ASCII_DIGITS, TIBETAN_DIGITS) if back else new).otherwise(p)

            return F.array_join(F.transform(pieces, one), "")

        return F.when(ok, F.struct(put(tibetan, True).alias("dz"), put(english, False).alias("en")))

    return let(digits_in(dz), whole)


def has_repetition(c: Column, n: int = 4, limit: int = 3) -> Column:
    """Whether some n-gram of words occurs more than ``limit`` times."""

    def often(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        # Sorted, a gram that occurs often enough stands again ``limit`` places on.
        return let(F.array_sort(grams), lambda r: F.exists(F.sequence(F.lit(1), F.size(r) - limit), lambda i: F.element_at(r, i) == F.element_at(r, i + limit)))

    return let(chunks(c), lambda words: F.when((F.size(words) < 2 * n) | (F.size(words) - n + 1 <= limit), False).otherwise(often(words)))


def count_of(c: Column, piece: str) -> Column:
    """How often a one-character string occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))


def capitalize(c: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1_000_000_000)))


def has_tibetan(c: Column) -> Column:
    return c.rlike(r"[\x{0F00}-\x{0FFF}]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def direction_key(src: Column, tgt: Column) -> Column:
    return F.concat(F.left(src, F.lit(3)), F.lit("2"), F.left(tgt, F.lit(3)))


#: The border of a word of ASCII letters, digits and underscores, whatever the flags around it and the Java version: RE2's ``\b``.
ASCII_BORDER = r"(?-iuU:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def swap_english(sentence: Column, old: Column, new: Column, ascii_words: bool = False) -> Column:
    """``old`` (plural too) replaced by ``new``, its plural kept with a small s, and a/an set right after it.

    A term that itself ends in s counts as plural, as upstream has it. With ``ascii_words`` any other letter borders a
    word, as in RE2's patterns and so in SQL: the last three letters of "Éthe" are a word of their own then.
    """
    flags, border, sound = ("(?iu)", ASCII_BORDER, "[A-Za-z0-9_&&[^aeiouAEIOU]]") if ascii_words else ("(?iU)", r"\b", r"[^aeiouAEIOU\W]")
    own = F.regexp_replace(new, r"([\\$])", r"\\$1")
    term = F.concat(F.lit(flags + border + r"\Q"), old, F.lit(r"\E"))
    # The plural's s is found and dropped in one pass, so that a replacement is never replaced again.
    kept = F.when(F.lower(old).endswith("s"), F.regexp_replace(sentence, F.concat(term, F.lit("s?" + border)), F.concat(own, F.lit("s")))).otherwise(
        _plural(F.regexp_replace(sentence, F.concat(term, F.lit("(s?)" + border)), F.concat(own, F.lit(MARK + "$1" + MARK))))
    )
    some = F.regexp_replace(kept, rf"(?U){border}an (?={sound})", "a ")
    return F.regexp_replace(some, rf"(?U){border}a (?=[aeiouAEIOU])", "an ")


#: A character that no text holds: a Unicode noncharacter.
MARK = "\ufdd0"


def _plural(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{MARK}[sSſ]{MARK}", "s"), f"{MARK}.?{MARK}", "")
