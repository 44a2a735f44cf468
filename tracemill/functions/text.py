"""Column functions on trace texts. All are built-in expressions but ``remove_repetitions``."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracemill.config import ABBREVIATIONS, NEUTRAL, PARAMS

DOT = "\u00a7DOT\u00a7"


#: What ``(?U)\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(c, F.lit(WHITE))  # looks at the ends alone


def word_count(c: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


#: Dots of abbreviations with one dot, told by the letters before them.
_SHORT = "|".join(a[:-1] for a in ABBREVIATIONS if a.count(".") == 1)
#: White space between sentences: a blank line, or after a stop white space before a capital letter or with a line end. Only
#: white space is looked at, as all else begins no match.
_STOP = r"(?<=[.!?\u3002\uff01\uff1f])"
_BETWEEN = rf"(?U)(?=\s)(?<!\s)(?:\s*\n\s*\n\s*|{_STOP}(?:\s+(?=[A-Z\u4e00-\u9fff])|\s*\n\s*))"
_ITEMS = r"(?U)(?<!\s)\s*\n\s*(?=\d+[.)]\s|-\s|\*\s|\u2022\s)"


def sentences(text: Column, min_words: int = PARAMS.min_words) -> Column:
    """Array of sentences in order, nothing for texts under 10 characters.

    Paragraphs end at blank lines, sentences after an English or Chinese stop that white space and a capital (or
    Chinese) letter or a line end follows, but not at the full stops of abbreviations and decimals; list items are
    cut out of sentences. Bold and italic marks go. Pieces with fewer than ``min_words`` words are dropped before
    and after list items are cut.

    The text is cut once as a whole: a run of white space is a boundary by itself, whichever paragraph it is in. Rows of
    sentences should be made with ``posexplode_outer``, as the optimiser copies the expression into a filter for ``posexplode``.
    """
    t = strip(text)
    long_enough = F.length(t) >= 10
    t = F.regexp_replace(t, "\r\n", "\n")
    t = F.regexp_replace(t, r"(?d)\*\*(.+?)\*\*", "$1")
    t = F.regexp_replace(t, r"(?d)\*(.+?)\*", "$1")
    t = F.regexp_replace(t, rf"\.(?<=(?:{_SHORT})\.)", DOT)
    for short in ABBREVIATIONS:
        if short.count(".") > 1:
            t = F.replace(t, F.lit(short), F.lit(short.replace(".", DOT)))
    t = F.regexp_replace(t, r"(?U)\.(?<=\d\.)(?=\d)", DOT)
    enough = lambda s: s.rlike(rf"(?U)^\s*+(?:\S++\s++){{{min_words - 1}}}\S")
    found = F.filter(F.transform(F.split(strip(t), _BETWEEN, -1), lambda s: F.replace(s, F.lit(DOT), F.lit("."))), enough)
    items = F.flatten(F.transform(found, lambda s: F.when(s.contains("\n"), F.filter(F.split(s, _ITEMS, -1), enough)).otherwise(F.array(s))))
    return F.when(long_enough, items).otherwise(F.array().cast("array<string>"))


#: Letters that ``(?iu)`` takes for another besides its capital.
_ALIKE = {"s": "ſ", "k": "K", "i": "İı"}


def whole_word_list(patterns: list[str]) -> list[str] | None:
    """The words, in small letters, if each pattern is another whole word such as ``\bthat\b``; else None."""
    found = [re.fullmatch(r"\\b([A-Za-z]+)\\b", p) for p in patterns]
    words = [m[1].lower() for m in found if m]
    return words if len(set(words)) == len(patterns) else None


def words_found(text: Column, words: list[str]) -> Column:
    """Array of the occurrences of whole words in a text, whatever the case, in small letters: one pass for all words."""
    letter = lambda c: f"[{c}{c.upper()}{_ALIKE.get(c, '')}]"
    heads = "".join(letter(c)[1:-1] for c in sorted({w[0] for w in words}))
    pattern = rf"(?=[{heads}])\b(?:{'|'.join(''.join(map(letter, w)) for w in words)})\b"
    alike, plain = ("".join(x) for x in zip(*[(a, c) for c, more in _ALIKE.items() for a in more]))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.lower(F.translate(w, alike, plain)))


def with_words(text: Column, lexicon: dict[str, list[str]], of_words, of_patterns) -> Column:
    """``of_words(array of occurrences, words by key)`` for a lexicon of whole words, which are looked up in one pass, else ``of_patterns()``."""
    words = {k: whole_word_list(ps) for k, ps in lexicon.items()}
    if not words or None in words.values():
        return of_patterns()
    found = words_found(text, sorted({w for ws in words.values() for w in ws}))
    return F.get(F.transform(F.array(found), lambda f: of_words(f, words)), F.lit(0))  # the pass is made once, however often it is read


def marker_count(text: Column, patterns: list[str]) -> Column:
    """Occurrences of all patterns, whatever the case; each pattern counts on its own. Null or empty text: 0."""
    total = sum((F.regexp_count(text, F.lit(f"(?iu){p}")) for p in patterns), F.lit(0))
    return F.coalesce(total, F.lit(0)).cast("long")


def marker_counts(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """``marker_count`` of each category, as an array in the lexicon's order."""
    count = lambda f, ws: F.coalesce(F.size(F.filter(f, lambda w: w.isin(ws))), F.lit(0)).cast("long")
    patterns = lambda: F.array(*[marker_count(text, ps) for ps in lexicon.values()])
    return with_words(F.coalesce(text, F.lit("")), lexicon, lambda f, words: F.array(*[count(f, ws) for ws in words.values()]), patterns)


def region(text: Column, start: float, end: float) -> Column:
    """The characters of a text from one share of its length to another."""
    n = F.length(text)
    a, b = (n * F.lit(start)).cast("int"), (n * F.lit(end)).cast("int")
    return F.substring(text, a + 1, b - a)


def density(count: Column, length: Column) -> Column:
    """Per 1000 characters, 0 for texts without any."""
    return F.when(length >= 1, count * F.lit(1000.0) / length).otherwise(0.0)


def sentence_state(sentence: Column, lexicon: dict[str, list[str]]) -> Column:
    """The state with most patterns that occur; the first of the lexicon on ties, neutral if none does."""

    # One array, so that each pattern is matched once: of equal scores the larger place wins, and neutral stands over all at 0.
    def best(hits) -> Column:
        scored = [F.struct(F.lit(0).alias("score"), F.lit(1).alias("place"), F.lit(NEUTRAL).alias("state"))]
        scored += [F.struct(hits(s).alias("score"), F.lit(-i).alias("place"), F.lit(s).alias("state")) for i, s in enumerate(lexicon)]
        return F.array_max(F.array(*scored))["state"]

    matched = lambda s: F.coalesce(sum((sentence.rlike(f"(?iu){p}").cast("int") for p in lexicon[s]), F.lit(0)), F.lit(0))
    of_words = lambda f, words: best(lambda s: sum((F.array_contains(f, w).cast("int") for w in words[s]), F.lit(0)))
    return with_words(F.coalesce(sentence, F.lit("")), lexicon, of_words, lambda: best(matched))


def cut_final_answers(text: Column) -> Column:
    """Only up to the end of the first "Final Answer" section when there are more than two."""
    heading = r"(?i)###?\s*Final\s*Answer"
    first = F.regexp_extract(text, rf"(?is)^(.*?###?\s*Final\s*Answer.*?)(?=###?\s*Final\s*Answer)", 1)
    return F.when((F.length(text) >= 100) & (F.regexp_count(text, F.lit(heading)) > 2), strip(first)).otherwise(text)


def cut_boxed(text: Column, slashes: int = 2) -> Column:
    """Only up to the second boxed answer when there are more than three.

    The pattern takes two backslashes as the rule was written, so that it hardly ever acts; ``slashes=1`` makes it act
    on what models write.
    """
    box = "\\\\" * slashes + r"boxed\{[^}]+\}"
    second = F.regexp_extract(text, rf"(?s)^(.*?{box}.*?{box})", 1)
    return F.when((F.length(text) >= 100) & (F.regexp_count(text, F.lit(box)) > 3), strip(second)).otherwise(text)


def _block_cut(text: str, least: int) -> int:
    """Where to cut a text that repeats a block three times, or -1. See ``remove_repetitions``.

    A block that occurs three times begins with a block of the least length that does, so one sort of the hashes of
    these leaves the places where longer ones can start. Hashes of all lengths come from the same prefix sums.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    if n < 3 * least:
        return -1
    up = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:n])))

    def repeated(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, group of equal blocks of each) of the blocks that three places or more begin, by group and place."""
        hashes = (sums[places + size] - sums[places]) * up[n - places]
        order = np.argsort(hashes, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(hashes[order]) != 0)))
        count = np.diff(np.append(head, len(order)))
        return places[order][np.repeat(count >= 3, count)], np.repeat(np.arange(int((count >= 3).sum())), count[count >= 3])

    starts = np.sort(repeated(np.arange(n - least + 1), least)[0])
    for size in range(200, least - 1, -10) if len(starts) else ():
        places, group = repeated(starts[starts <= n - size], size) if (starts <= n - size).any() else (starts[:0], starts[:0])
        if not len(places):
            continue
        # Of each group the first place, the first one after it without overlap, and so on: three must be of the group.
        keys = group * (n + 1) + places
        first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        second = np.minimum(np.searchsorted(keys, keys[first] + size), len(keys) - 1)
        third = np.minimum(np.searchsorted(keys, keys[second] + size), len(keys) - 1)
        apart = (group[third] == group[first]) & (places[third] >= places[second] + size) & (group[second] == group[first]) & (places[second] >= places[first] + size)
        for k in np.flatnonzero(apart)[np.argsort(places[first[apart]])].tolist():
            a, b, c = (int(places[x[k]]) for x in (first, second, third))
            if text[a : a + size] == text[b : b + size] == text[c : c + size]:
                return b + size
    return -1


def repetition_cutter(least: int = PARAMS.min_chars):
    """T1c as a pandas UDF: hashes of all blocks of a length at once, confirmed on the strings."""

    @pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at = _block_cut(t, least) if isinstance(t, str) and len(t) >= 2 * least else -1
            out.append(t[:at].strip() if at >= 0 else t)
        return pd.Series(out, dtype=object)

    return cut


def remove_repetitions(text: Column, least: int = PARAMS.min_chars) -> Column:
    """The first of three cuts that applies. Texts shorter than twice ``least`` stay as they are.

    Repeated final answers, repeated boxed answers, then the largest block (200, 190 ... ``least`` characters) and of
    that length the earliest that occurs three times without overlap: cut after its second occurrence.
    """
    long_enough = F.length(text) >= 2 * least
    answers = F.regexp_count(text, F.lit(r"(?i)###?\s*Final\s*Answer")) > 2
    boxes = F.regexp_count(text, F.lit(r"\\\\boxed\{[^}]+\}")) > 3
    return F.when(~long_enough, text).when(answers, cut_final_answers(text)).when(boxes, cut_boxed(text)).otherwise(repetition_cutter(least)(text))


# Headings that begin the answer.
ANSWER_HEADINGS = [
    r"\nThe most likely (?:diagnosis|answer|cause)",
    r"\n\*\*(?:Answer|Final Answer|The answer)",
    r"\n#{1,3}\s*(?:Answer|Final Answer|Conclusion|Key Points)",
]


def split_thinking(raw: Column, has_tags: Column) -> Column:
    """struct(thinking, answer) of a cleaned output.

    With think tags, if the model has them and they are closed; else at the earliest answer heading of which the
    pattern's first match lies beyond offset 100; else at the last blank line; else both are the whole text.
    """
    tagged = raw.rlike(r"(?s)<think>.*?</think>") & has_tags
    inner = F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1)
    after = F.regexp_extract(raw, r"(?s)<think>.*?</think>(.*)$", 1)
    first = [F.regexp_instr(raw, F.lit(p)) - 1 for p in ANSWER_HEADINGS]
    cut = F.least(*[F.when(p > 100, p) for p in first])
    blank = F.length(raw) - F.length(F.substring_index(raw, "\n\n", -1)) - 2
    thinking = F.when(tagged, strip(inner)).when(cut.isNotNull(), strip(F.substring(raw, F.lit(1), cut))).when(blank >= 0, strip(F.substring(raw, F.lit(1), blank))).otherwise(raw)
    answer = F.when(tagged, strip(after)).when(cut.isNotNull(), strip(F.substring(raw, cut + 1, F.length(raw)))).otherwise(strip(F.substring_index(raw, "\n\n", -1)))
    return F.struct(thinking.alias("thinking"), answer.alias("answer"))


def drop_special_tokens(raw: Column) -> Column:
    """Without chat tokens such as ``<|end|>``; think tags stay."""
    return strip(F.regexp_replace(raw, r"<\|[^>]+\|>", ""))


def split_by_tags_first(raw: Column, has_tags: Column) -> Column:
    """The split of outputs of which only the thinking may loop: closed think tags first, then T1 on the thinking alone.

    Where there are no tags, repetitions are removed from the whole before T2 looks for headings.
    """
    text = drop_special_tokens(raw)
    tagged = text.rlike(r"(?s)<think>.*?</think>") & has_tags
    parts = split_thinking(F.when(tagged, text).otherwise(remove_repetitions(text)), has_tags)
    return F.struct(remove_repetitions(parts["thinking"]).alias("thinking"), parts["answer"].alias("answer"))


def predicted_option(text: Column) -> Column:
    """T4: A to E by the first of five rules that matches, or null: boxed, "answer is", bold, first line, last lone letter."""
    found = lambda c: F.nullif(F.upper(c), F.lit(""))
    first_line = strip(F.substring_index(strip(text), "\n", 1))
    lone = F.regexp_extract_all(F.substring(text, 1, 500), F.lit(r"(?U)\b([A-E])\b"), F.lit(1))
    return F.coalesce(
        found(F.regexp_extract(text, r"\\boxed\{([A-E])\}", 1)),
        found(F.regexp_extract(text, r"(?i)(?:the answer is|answer:\s*|answer is)\s*\*?\*?\(?([A-E])\)?", 1)),
        found(F.regexp_extract(text, r"\*\*\(?([A-E])\)?\*\*", 1)),
        found(F.regexp_extract(first_line, r"^\*?\*?\(?([A-E])\)?[.)\s:*]", 1)),
        found(F.try_element_at(lone, F.lit(-1))),
    )


def chosen_option(answer: Column, thinking: Column) -> Column:
    """T4 as graded: from the answer without its repetitions, else from the thinking without its own."""
    return F.coalesce(predicted_option(remove_repetitions(answer)), predicted_option(remove_repetitions(thinking)))


def kept_answer(answer: Column, most: int = 2000) -> Column:
    """P5: the first characters of an answer; the second generator keeps 3000."""
    return F.substring(answer, 1, most)


def options_text(options: Column) -> Column:
    """Lines "K) V" in order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")


def option_value(options: Column, key: Column) -> Column:
    """Text of an option, ``?`` if there is none."""
    return F.coalesce(F.try_element_at(options, key), F.lit("?"))


def fill(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
