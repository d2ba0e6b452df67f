"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1, drawn from its code point alone. A run of three
letters is bound by multiplying the vectors, each rotated by its place; a text is the bundle
(sum) of its runs, a language the bundle of its texts' unit vectors. A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from functools import cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import extend_rows, held_out, map_rows
from tideline.storage import materialize, scratch

UNKNOWN = "und"
GAP = 32


@cache
def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct three-letter runs of a text, packed into integers, and their counts.
    Letters are lower-cased; whatever stands between letters is one gap."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    points = np.where(letter_table()[points], points, GAP)
    points = points[~((points == GAP) & (np.roll(points, 1) == GAP)) | (np.arange(len(points)) == 0)]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


class Space:
    """The vectors of letters and runs; runs that were needed are kept, up to ``most`` rows."""

    def __init__(self, dims: int, seed: int, most: int = 40_000):
        self.dims, self.seed, self.most = dims, seed, most
        self.forget()

    def forget(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.empty(0, np.int64)
        self.place = np.empty(0, np.int64)
        self.vectors = np.empty((1024, self.dims), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims).astype(np.float32) * 2 - 1
        return self.letters[point]

    def bind(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Places of these runs' vectors."""
        at = np.searchsorted(self.codes, codes)
        if len(self.codes) and (self.codes[np.minimum(at, len(self.codes) - 1)] == codes).all():
            return self.place[at]
        if len(self.codes) > self.most:
            self.forget()
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        first = len(self.codes)
        while first + len(new) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        for i, code in enumerate(new.tolist()):
            self.vectors[first + i] = self.bind(code)
        codes_now, place = np.concatenate([self.codes, new]), np.concatenate([self.place, np.arange(first, first + len(new))])
        order = np.argsort(codes_now)
        self.codes, self.place = codes_now[order], place[order]
        return self.place[np.searchsorted(self.codes, codes)]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's unit vector; None without a letter. Works in blocks of runs."""
        codes, counts = runs(text or "")
        if not len(codes):
            return None
        total = np.zeros(self.dims, np.float32)
        for i in range(0, len(codes), 8192):
            part = slice(i, i + 8192)
            places = self.rows(codes[part])
            total += counts[part].astype(np.float32) @ self.vectors[places]
        return total / (np.linalg.norm(total) or 1.0)


#: Unit vectors are added as integers of this many steps: sums do not depend on their order.
STEPS = 1 << 20


class Profiles:
    """Prototypes of languages; ``predict`` gives the language and the cosine."""

    def __init__(self, dims: int, seed: int, languages: list[str], prototypes: np.ndarray):
        self.dims, self.seed, self.languages, self.prototypes = dims, seed, languages, prototypes

    @classmethod
    def of_sums(cls, sums: dict[str, np.ndarray], dims: int, seed: int) -> Profiles:
        """From every language's sum of its texts' vectors."""
        languages = sorted(sums)
        made = [sums[x] / (np.linalg.norm(sums[x]) or 1.0) for x in languages]
        return cls(dims, seed, languages, np.array(made, np.float32).reshape(-1, dims))

    @classmethod
    def learn(cls, rows: list[tuple[str, str]], dims: int = 512, seed: int = 7) -> Profiles:
        """From (text, language) pairs."""
        return cls.of_sums(language_sums(Space(dims, seed), rows), dims, seed)

    @property
    def margin(self) -> float:
        """The cosine that a text unlike every language reaches in about 1 of 200 cases: each of
        the cosines is then noise of deviation 1 / sqrt(dims), and the largest one counts."""
        return NormalDist().inv_cdf(1 - 0.005 / max(1, len(self.languages))) / self.dims**0.5

    def predict(self, space: Space, text: str | None) -> tuple[str, float]:
        v = space.bundle(text)
        if v is None or not self.languages:
            return UNKNOWN, 0.0
        cosines = self.prototypes @ v
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def language_sums(space: Space, rows: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    sums: dict[str, np.ndarray] = {}
    for text, lang in rows:
        if (v := space.bundle(text)) is not None:
            sums.setdefault(lang, np.zeros(space.dims, np.int64))
            sums[lang] += np.round(v * STEPS).astype(np.int64)
    return sums


def training_rows(docs: DataFrame, per_language: int = 600, most_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """A bounded sample of rows (``text, lang``) to learn from: about ``per_language`` whole texts (fewer,
    but one at least, if there are so many languages that these were over ``most_rows``) for
    every value of ``lang``, chosen by a hash of the id. Rows that are held out, and rows without
    id, lang or text, are never among them."""
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    wide = 1 << 30
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(wide))
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(drawn).alias("least")), "language-counts")
    languages = counts.count()
    each = max(1, min(per_language, most_rows // max(1, languages)))
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("count")) * wide
    shares = counts.select(F.col("lang").alias("of"), F.greatest(F.ceil(share), F.col("least") + 1).alias("share"))
    near = F.broadcast(shares) if languages <= most_rows else shares
    return rows.join(near, F.col("lang") == F.col("of")).where(drawn < F.col("share")).select("text", "lang")


def learn_profiles(docs: DataFrame, per_language: int = 600, dims: int = 512, seed: int = 7) -> Profiles:
    """Profiles from the bounded sample of ``training_rows``. Texts become vectors where they are; what
    comes to the driver is a sum of ``dims`` numbers for each language, whatever the texts' lengths. An empty table gives no language."""

    def make():
        space = Space(dims, seed)
        return lambda rows: [(lang, total.tolist()) for lang, total in language_sums(space, rows).items()]

    with scratch(docs.sparkSession):
        parts = map_rows(training_rows(docs, per_language), make, [("lang", "string"), ("total", "array<bigint>")])
        sums = parts.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
        rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("all")).select("lang", F.transform("all", lambda x: x["v"]).alias("total"))
        found = {r.lang: np.array(r.total, np.int64) for r in rows.collect()}
    return Profiles.of_sums(found, dims, seed)


def identify_language(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """Predict the language of the whole ``text`` of every row.

    Returns ``keep`` (default ``doc_id``), ``lang_pred`` and ``score``, the cosine with that
    language's prototype cut to 0..1. Null and empty texts and texts without a letter, and any
    text if no language was learned, get ``und`` and 0. Ties go to the first language in order.
    Repeated rows stay repeated; columns not in ``keep`` are ignored. Narrow: no shuffle; the
    profiles (languages x dims floats) travel in the closure.
    """

    def make():
        space = Space(profiles.dims, profiles.seed)
        return lambda texts: [profiles.predict(space, text) for text in texts]

    return extend_rows(docs, ["doc_id"] if keep is None else keep, make, [("lang_pred", "string"), ("score", "double")])
