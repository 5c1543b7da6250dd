"""Secrets in texts: three fixed patterns, and character Markov models for the rest.

First-order models over 67 symbols and an end are trained from labelled
samples: one model of ordinary identifiers, and one of random strings for each
alphabet that keys are written in.  A candidate token's log-likelihood ratio is
that of an even mixture of the random models against the ordinary one.  The
samples are generated by rule from a seed and a public vocabulary, so a token's
verdict depends on nothing but the token.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

#: The patterns, in the order in which ties are listed, and the fewest characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", 6), ("access", 20), ("hex", 24))

#: A candidate token is a maximal run of so many model symbols at least (shorter ones hold too little evidence),
#: and is random at so many natural log odds in all and by symbol.
MIN_TOKEN, LOG_ODDS, ODDS_BY_SYMBOL = 16, 12.0, 0.25
#: Labelled strings generated for the ordinary model, and for the model of each alphabet.
ORDINARY_STRINGS, RANDOM_STRINGS = 60_000, 4000
#: Alphabets of random strings, and rows of the keyboard.
_DIGITS, _CAPITALS, _SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _CAPITALS + "234567", _SMALL + _DIGITS, _CAPITALS + _DIGITS, _CAPITALS + _SMALL + _DIGITS,
    _CAPITALS + _SMALL + _DIGITS + "+/", _CAPITALS + _SMALL + _DIGITS + "-_", _CAPITALS + _SMALL,
)
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(256, len(_SYMBOLS), np.uint8)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_N = len(_SYMBOLS) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= KINDS[0][1]] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= KINDS[1][1]]
    found += [(m.start(), m.end(), 2) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


#: A maximal run of hex digits is one match of HEX, so the minimum can be part of the pattern.
HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % KINDS[2][1])


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row offsets of the maximal runs of model symbols, in bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _CODE[data] < _N - 1
    before, after = inside[:-2].copy(), inside[2:].copy()
    if len(data):
        before[at[:-1][at[:-1] < len(data)]] = False
        ends = at[1:] - 1
        after[ends[ends >= 0]] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    return starts, np.flatnonzero(inside[1:-1] & ~after) + 1, np.searchsorted(starts, at)


def _count(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol-pair counts in the runs, each between two end symbols."""
    if not len(starts):
        return np.zeros(_N * _N, np.int64)
    codes = _CODE[data].astype(np.int32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts + 1] += 1
    inside[ends] -= 1
    second = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    pairs = np.bincount(codes[second - 1] * _N + codes[second], minlength=_N * _N)
    pairs[(_N - 1) * _N :] += np.bincount(codes[starts], minlength=_N)
    pairs[_N - 1 :: _N] += np.bincount(codes[ends - 1], minlength=_N)
    return pairs


def vocabulary_words(path: str) -> list[str]:
    """The words of a ranked vocabulary, four ASCII small letters at least after a space, by rank."""
    with open(path, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]) for line in lines if line.strip())
        return [t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{4,}", t)]


def ordinary_strings(words: list[str], n: int, seed: int) -> list[str]:
    """Identifiers, paths, numbers, dates, rules and rows of the keyboard as people write them."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        own = [words[i] for i in rng.integers(0, len(words), int(rng.integers(1, 8)))]
        style, number = int(rng.integers(0, 14)), str(int(10 ** rng.uniform(0, 5)))
        if style < 2:
            out.append("".join(own[:2]))
        elif style < 4:
            out.append(own[0] + "".join(w.capitalize() for w in own[1:]) + (number if rng.random() < 0.1 else ""))
        elif style == 4:
            out.append("".join(w.capitalize() for w in own) + (number if rng.random() < 0.1 else ""))
        elif style in (5, 6, 7, 8):
            text = "_-_/"[style - 5].join(own) + ("_-_/"[style - 5] + number if rng.random() < 0.2 else "")
            out.append(text.upper() if style == 7 else text)
        elif style == 9:
            parts = ["".join(w.capitalize() for w in own[i : i + 2]) if rng.random() < 0.4 else own[i] for i in range(len(own))]
            out.append("/" * int(rng.integers(0, 3)) + "/".join(parts))
        elif style == 10:
            out.append("".join(rng.choice(list(_DIGITS), int(rng.integers(1, 24)))))
        elif style == 11:
            out.append(f"{rng.integers(1970, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}" + ("T" + number if rng.random() < 0.3 else "/" + own[0] if rng.random() < 0.5 else ""))
        elif style == 12:
            symbols = "-=_/+" if rng.random() < 0.5 else _SYMBOLS
            out.append(symbols[int(rng.integers(0, len(symbols)))] * int(rng.integers(1, 60)))
        else:
            row = (_SMALL, _CAPITALS, _DIGITS, "qwertyuiop", "asdfghjkl")[int(rng.integers(0, 5))]
            first = int(rng.integers(0, 4))
            out.append((row * 2)[first : first + int(rng.integers(4, 30))])
    return out


def random_strings(letters: str, n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), int(rng.integers(16, 64)))) + "=" * (int(rng.integers(0, 3)) if "+" in letters else 0) for _ in range(n)]


def _log_model(strings: list[str]) -> np.ndarray:
    """Log probabilities of symbol pairs, from add-one smoothed counts."""
    data = np.frombuffer(" ".join(strings).encode(), np.uint8)
    starts, ends, _ = _runs(data, np.array([0, len(data)]))
    smooth = _count(data, starts, ends).reshape(_N, _N) + 1.0
    return np.log(smooth / smooth.sum(1, keepdims=True)).ravel()


def train(words: list[str], seed: int = 77) -> np.ndarray:
    """The models' log probabilities of symbol pairs: the ordinary one first, then one for each alphabet."""
    models = [_log_model(ordinary_strings(words, ORDINARY_STRINGS, seed))]
    models += [_log_model(random_strings(letters, RANDOM_STRINGS, seed + 1 + i)) for i, letters in enumerate(ALPHABETS)]
    return np.array(models)


@functools.lru_cache(maxsize=4)
def models_of(path: str) -> np.ndarray:
    return train(vocabulary_words(path))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_ratios(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, models: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each run: the mixture of the random models against the ordinary one."""
    if not len(starts):
        return np.zeros(0)
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)  # a run has one pair more than symbols
    total = int((sizes + 1).sum())
    places = np.repeat(starts - begins, sizes + 1) + np.arange(total)
    inner = np.ones(total, bool)
    inner[begins] = False
    first = np.full(total, _N - 1, np.int64)
    first[inner] = _CODE[data[places[inner] - 1]]
    second = np.full(total, _N - 1, np.int64)
    closes = begins + sizes
    inside = np.ones(total, bool)
    inside[closes] = False
    second[inside] = _CODE[data[places[inside]]]
    sums = np.add.reduceat(models[:, first * _N + second], begins, axis=1)
    return np.logaddexp.reduce(sums[1:], axis=0) - np.log(len(models) - 1) - sums[0]


def is_random(ratios: np.ndarray, sizes: np.ndarray, log_odds: float = LOG_ODDS) -> np.ndarray:
    return (ratios >= log_odds) & (ratios >= ODDS_BY_SYMBOL * sizes)


def _scan(models: np.ndarray, log_odds: float):
    kinds = pa.array([k for k, _ in KINDS] + ["markov"])

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                data, at, text = K.valid(part)
                points = K.code_points(data)
                firsts = points[at]
                starts, ends, rows = _runs(data, at)
                row_of = np.repeat(np.arange(part.num_rows), np.diff(rows))
                odd = np.flatnonzero(ends - starts >= MIN_TOKEN)
                odd = odd[is_random(token_ratios(data, starts[odd], ends[odd], models), (ends - starts)[odd], log_odds)]
                extra: dict[int, list[tuple[int, int, int]]] = {}
                for i in odd.tolist():
                    r = int(row_of[i])
                    extra.setdefault(r, []).append((int(points[starts[i]] - firsts[r]), int(points[ends[i]] - firsts[r]), 3))
                spans, counts = [], []
                for r in range(part.num_rows):
                    own = base_spans(text[firsts[r] : firsts[r + 1]])
                    if r in extra:
                        own = sorted(own + [x for x in extra[r] if all(x[1] <= s or x[0] >= e for s, e, _ in own)], key=lambda s: (s[0], s[2]))
                    counts.append(len(own))
                    spans += own
                flat = np.array(spans, np.int32).reshape(-1, 3)
                struct = pa.StructArray.from_arrays([kinds.take(pa.array(flat[:, 2])), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["kind", "start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), lists], ["doc_id", "text", "spans"])

    return run


def scan_secrets(docs: DataFrame, log_odds: float = LOG_ODDS, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, spans array<struct<kind, start, end>> (code points, end exclusive), by start and kind.

    One row per row of `docs` (doc_id, text; other columns are ignored).  Kinds
    are assign, access and hex by the fixed patterns, and markov for maximal
    runs of MIN_TOKEN or more of A-Z a-z 0-9 + / _ - = that the models call
    random and that overlap no pattern's span.  `vocabulary` is the path of a
    public vocabulary on the driver, from whose words the ordinary samples are
    made.  A null or empty text has no spans; doc_ids are carried along, null or
    repeated; no rows give no rows.  One narrow pass, no shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(models_of(vocabulary or default_vocabulary()), log_odds), "doc_id long, text string, spans array<struct<kind: string, start: int, end: int>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """`docs` with every span in text, overlapping ones together, replaced by `mark`; all other columns stay."""
    models = models_of(vocabulary or default_vocabulary())
    fields = docs.schema

    def run(batches):
        scan = _scan(models, LOG_ODDS)
        for batch in batches:
            done = []
            narrow = batch.select([i for i, name in enumerate(batch.schema.names) if name in ("doc_id", "text")])
            for part in scan(iter([narrow])):
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    if text and spans:
                        out, last = [], 0
                        for span in spans:
                            if span["end"] > last:
                                if span["start"] >= last:
                                    out += [text[last : span["start"]], mark]
                                last = span["end"]
                        text = "".join(out) + text[last:]
                    done.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    return docs.mapInArrow(run, fields)
