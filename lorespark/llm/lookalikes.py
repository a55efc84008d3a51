"""One consistent form for names that look the same but are written with different characters.

Names are cut into words (at signs and at changes of letter case, which look-alikes do not touch). The clean spellings
of all words form the vocabulary. It is held in tries, one for each shard of words, and every spelling that occurs is
walked through the trie of its shard by an edit automaton in which look-alikes and characters that show nothing cost
nothing; what arrives at cost 0 is spelled as the most frequent clean spelling there. Only words that reach no
vocabulary word are normalised by table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.util.scratch import Scratch
from lorespark.util.skew import every_part, lookup_join, pair_join, part_in, parts_of, sketch

# Letters of other scripts and the Latin letter of equal shape.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "ι": "i",
    # Latin letters of other alphabets
    "ɑ": "a", "ɡ": "g", "ı": "i",
    # Armenian
    "Օ": "O", "օ": "o", "Տ": "S", "Ս": "U", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ꮩ": "V",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Characters that show nothing besides those of the format category, and blanks besides the space separators.
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
BLANKS = "\t\n\r\x0b\x0c\x85"
#: Vocabulary words of one trie, about, and words of one shape that are walked in one task.
TRIE_SPELLINGS, WALKED = 20_000, 200_000


@lru_cache(1 << 16)
def shape(ch: str) -> str:
    """What a character looks like: '' if it shows nothing, ' ' for blanks, else a plain character, Latin if it can be.

    Wide, narrow and font forms of a character (mathematical alphabets) look like the character, ligatures of letters
    and Roman numerals like the letters they are made of; this is read from the Unicode data.
    """
    if ord(ch) in UNSEEN or unicodedata.category(ch) == "Cf":
        return ""
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in BLANKS:
        return " "
    made = unicodedata.decomposition(ch)
    letters = made.startswith("<compat>") and ("LIGATURE" in unicodedata.name(ch, "") or unicodedata.category(ch) == "Nl")
    if letters or made.startswith(("<wide>", "<narrow>", "<font>")):
        ch = unicodedata.normalize("NFKC", ch)
    return "".join(LOOKALIKES.get(c, c) for c in ch)


def fold(text: str) -> str:
    """Normal form by table: equal for two texts exactly if they look the same."""
    shapes = "".join(map(shape, unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", shapes)).strip(" ")


def cut_words(text: str) -> list[tuple[bool, str]]:
    """(is a word, characters) in order; the cuts depend on shapes only, so they fall alike in names that look the same."""
    out: list[list] = []
    chars = unicodedata.normalize("NFD", text)
    kinds = []
    for ch in chars:
        s = shape(ch)
        c = s[:1]
        if not c:
            kinds.append("-")
        elif unicodedata.category(c)[0] == "M":
            kinds.append("m")
        elif c.isalpha():
            kinds.append("U" if c.isupper() else "l")
        elif c.isdigit():
            kinds.append("d")
        else:
            kinds.append("s")
    visible = [i for i, k in enumerate(kinds) if k in "Ulds"]
    starts = set()
    for n, i in enumerate(visible):
        k, before = kinds[i], kinds[visible[n - 1]] if n else ""
        after = kinds[visible[n + 1]] if n + 1 < len(visible) else ""
        if not before or "s" in (k, before) or (k == "U" and (before != "U" or after == "l")) or (k == "d") != (before == "d"):
            starts.add(i)
    for i, ch in enumerate(chars):
        if i in starts or not out:
            out.append([kinds[i] in "Uld", ch])
        else:
            out[-1][1] += ch
    return [(w, unicodedata.normalize("NFC", t)) for w, t in out]


def is_clean(word: str) -> bool:
    """A spelling fit for the vocabulary: nothing unseen, no wide forms, composed, letters of one script."""
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in word if c.isalpha()}
    return len(scripts) <= 1 and unicodedata.normalize("NFC", word) == word and all(len(shape(c)) == 1 and not unicodedata.decomposition(c).startswith("<") for c in word)


class Trie:
    """Vocabulary of clean spellings with their frequencies, over decomposed characters."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.alike: list[dict[str, list[int]]] = [{}]  # children by shape: what costs nothing
        self.ends: dict[int, tuple[int, str]] = {}

    def add(self, word: str, count: int) -> None:
        node = 0
        for ch in unicodedata.normalize("NFD", word):
            child = self.children[node].get(ch)
            if child is None:
                child = self.children[node][ch] = len(self.children)
                self.alike[node].setdefault(shape(ch), []).append(child)
                self.children.append({})
                self.alike.append({})
            node = child
        self.ends[node] = (count, word)

    def walk(self, word: str, most: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -count, spelling) of the vocabulary words within `most` edits, best first.

        A look-alike instead of a character and an unseen character too many cost 0; any other character instead of
        one, one too many and one too few cost 1.
        """

        def grown(states: dict[int, int]) -> dict[int, int]:
            todo = list(states) if most else []
            while todo:
                node = todo.pop()
                for child in self.children[node].values():
                    if states[node] < most and states.get(child, most + 1) > states[node] + 1:
                        states[child] = states[node] + 1
                        todo.append(child)
            return states

        states = grown({0: 0})
        for here in (c for ch in unicodedata.normalize("NFD", "".join(x for x in unicodedata.normalize("NFD", word) if shape(x))) for c in shape(ch)):
            then: dict[int, int] = {}
            for node, cost in states.items():
                for child in self.alike[node].get(here, ()):
                    if then.get(child, most + 1) > cost:
                        then[child] = cost
                if cost < most:
                    for child in (*self.children[node].values(), node):
                        if then.get(child, most + 1) > cost + 1:
                            then[child] = cost + 1
            states = grown(then)
            if not states:
                return []
        return sorted((cost, -self.ends[n][0], self.ends[n][1]) for n, cost in states.items() if n in self.ends)


def walk_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(shard, part, is_entry, word, n), the entries of each shard and part before its words → (word, canon) of the words.

    canon is null for a word that reaches no entry.
    """
    trie, at = Trie(), None
    for b in batches:
        rows = []
        for shard, part, is_entry, word, n in zip(b["shard"], b["part"], b["is_entry"], b["word"], b["n"]):
            if (shard, part) != at:
                trie, at = Trie(), (shard, part)
            if is_entry:
                trie.add(word, int(n))
            else:
                found = trie.walk(word)
                rows.append((word, found[0][2] if found else None))
        yield pd.DataFrame(rows, columns=["word", "canon"])


def canonical_words(words: DataFrame, n_entries: int | None = None, hot: list | None = None) -> DataFrame:
    """(word, canon) of words (word, folded, clean, n), n the frequency; canon is null where the vocabulary has no such word.

    The shard of a word is a hash of its shapes, so a word and the spellings it may stand for meet; which of them it is
    the walk finds. A task holds one trie at a time and the words pass by it. The words of a shape with very many
    spellings are split over several tasks, each with the entries of this shape.
    """
    if n_entries is None or hot is None:
        row = words.agg(F.count_if("clean").alias("n"), sketch("folded").alias("hot")).first()
        n_entries, hot = row["n"], row["hot"]
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-n_entries // TRIE_SPELLINGS))
    parts = parts_of("folded", {x["item"]: -(-x["count"] // WALKED) for x in hot or [] if x["count"] > WALKED})
    shard = F.pmod(F.xxhash64("folded"), F.lit(shards)).cast("int").alias("shard")
    entries = words.where("clean").select(shard, every_part(parts).alias("part"), F.lit(True).alias("is_entry"), "word", "n")
    passing = words.select(shard, part_in(words.select("word", "folded"), "folded", parts).alias("part"), F.lit(False).alias("is_entry"), "word", F.lit(0).cast("long").alias("n"))
    met = entries.unionByName(passing).repartition(shards, "shard", "part").sortWithinPartitions("shard", "part", F.desc("is_entry"))
    return met.mapInPandas(walk_words, "word string, canon string")


def canonical_names(names: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(name, canon) of every distinct name of `names` (name); canon is equal exactly for names that look the same.

    A null name has no form and is left out; an empty or blank one has the form ''. Frequent words are salted when
    their spellings are put back into the names.
    """
    scratch = scratch or Scratch(names.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, i, w, word, fold(word) if w else "".join(map(shape, unicodedata.normalize("NFD", word))), w and is_clean(word)) for name in b["name"] for i, (w, word) in enumerate(cut_words(name) or [(False, "")])]
            yield pd.DataFrame(rows, columns=["name", "at", "is_word", "word", "folded", "clean"])

    parts = names.select("name").where("name is not null").distinct().mapInPandas(cut, "name string, at int, is_word boolean, word string, folded string, clean boolean")
    parts = scratch.save(parts)
    words, seen = scratch.save_counting(parts.where("is_word").groupBy("word", "folded", "clean").agg(F.count("*").alias("n")), n=F.count_if("clean"), hot=sketch("folded"))
    canon = scratch.save(canonical_words(words, seen["n"], seen["hot"]))
    met = lookup_join(parts.where("is_word"), canon, "word").select("name", "at", F.coalesce("canon", "folded").alias("canon"))
    every = met.unionByName(parts.where("not is_word").select("name", "at", F.col("folded").alias("canon")))
    # as many parts as a name has words
    whole = every.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "canon"))), lambda x: x["canon"]), "").alias("canon"))
    return whole.select("name", F.trim("canon").alias("canon"))


def lookalike_pairs(rows: DataFrame, forms: DataFrame, scope: list[str], key: str = "key", name: str = "name", scratch: Scratch | None = None) -> DataFrame:
    """(scope…, key_a, key_b): pairs of different keys of one scope whose names differ but look the same.

    Pairs are formed between different spellings of one form, never between rows of the same spelling.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    whole = lambda n: F.to_json(F.struct(*scope, F.col(n).alias("n")))
    rows = rows.select(*scope, key, name).where(F.col(key).isNotNull() & F.col(name).isNotNull()).distinct()
    names = rows.select(*scope, name).distinct().join(forms.select(F.col("name").alias(name), "canon"), name)
    spelled = scratch.save(names)
    several = spelled.groupBy(*scope, "canon").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo <> hi").select(*scope, "canon")
    several = scratch.save(spelled.join(several, [*scope, "canon"], "left_semi").select(whole("canon").alias("_c"), whole(name).alias("_a"), F.col(name).alias("_n")))
    others = several.select("_c", F.col("_a").alias("_b"), F.col("_n").alias("_m"))
    pairs = scratch.save(pair_join(several, others, "_c").where("_n < _m").select("_a", "_b"))
    # rows of the names that have a pair, then both sides of each pair
    paired = several.select("_a").distinct()
    known = scratch.save(rows.select(*scope, whole(name).alias("_a"), F.col(key).alias("x")).join(paired, "_a", "left_semi"))
    left = scratch.save(pair_join(known, pairs, "_a"))
    both = pair_join(left, known.select(F.col("_a").alias("_b"), F.col("x").alias("y")), "_b")
    return both.where("x <> y").select(*scope, F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
