"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF that adds spans the patterns miss.

The tagger is trained from labelled spans of the documents: those that the patterns find, and secrets (keys, tokens, passwords) where a text names them as such. Some
are rewritten (a phone number without its plus sign, a card number after another number, a secret with another name before it or none, all in
capitals), with all tags moved along. The tagger reads overlapping windows around digits and @; no valid span of any kind is without one, so the
rest of a text can hold none. The windows' paths are joined over the whole text: each character has the tag of the window in whose middle it lies, so spans may
be longer than windows. The surest of overlapping spans wins, and a span must pass its kind's test and touch no span of the patterns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.llm.char_tagger import CharTagger, codes
from heatloom.llm.common import texts_of, trained

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the tagger: those of the patterns, and secrets.
TAGGED = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so looking back changes nothing but the time for long runs.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}")
SECRET_END = re.compile(r"[A-Za-z0-9+/_-]")
#: Where a text names a secret as such: a label for training.
NAMED = re.compile(r"""(?:token|secret|password|api_?key) ?[=:] ?["']([A-Za-z0-9+/_-]{20,})["']""")
#: Characters of the secrets that stand for others in training.
ALPHABETS = ("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")
LEADS = ("", "key ", "auth=", "pw: ", "id ", "see ")

#: Characters in a window, how far the next one begins, and how far from a digit or @ the tagger reads.
WINDOW, STRIDE, AROUND = 128, 64, 64
#: Labelled windows that the tagger is trained on, at most; and training steps.
FIT_WINDOWS, FIT_STEPS = 4_000, 260
SURE = 0.9
#: Share of a run of a secret's characters that must have a secret's tags.
MOSTLY = 0.6


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def is_card(s: str) -> bool:
    digits = "".join(DIGIT.findall(s))
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(s: str) -> bool:
    return 9 <= len(DIGIT.findall(s)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: around each @, as far to the left as characters allow, and the longest domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    if text.isalpha() or not DIGIT.search(text):
        return out
    for kind, pattern, test in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        if kind != "phone" or "+" in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if test(m[0])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text near digits and @, that the tagger reads."""
    out: list[list[int]] = []
    for m in CUE.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows_of(a: int, b: int) -> range:
    """Where the windows of a stretch begin."""
    return range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)


def windows(text: str) -> list[int]:
    """Where windows begin."""
    return [s for a, b in stretches(text) for s in windows_of(a, b)]


def tagged(length: int, spans: list[tuple[int, str, int]]) -> list[int]:
    """0 outside, 2k + 1 and 2k + 2 at the first and the other characters of kind k."""
    tags = [0] * length
    for a, kind, b in spans:
        k = 2 * TAGGED.index(kind)
        for i in range(max(a, 0), min(b, length)):
            if tags[i] == 0:
                tags[i] = k + 1 if i == a else k + 2
    return tags


def padded(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WINDOW), np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = codes(t)
    return out


def exchanged(text: str, a: int, b: int) -> tuple[str, list[tuple[int, str, int]]]:
    """A window somewhere in the text in which another secret, of 20 to 460 characters, stands for the one at a: so that neither length nor alphabet is learned."""
    rng = np.random.default_rng(xxhash.xxh32_intdigest(text))
    letters = ALPHABETS[rng.integers(len(ALPHABETS))]
    size = int(rng.integers(20, 80) if rng.random() < 0.5 else rng.integers(80, 460))
    text = text[:a] + "".join(letters[k] for k in rng.integers(0, len(letters), size)) + text[b:]
    at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
    spans = [(a - at, "secret", a + size - at)]
    return text[at : at + WINDOW], [x for x in spans if x[2] > 0 and x[0] < WINDOW]


def rewritten(n: int, text: str, spans: list[tuple[int, str, int]]) -> tuple[str, list[tuple[int, str, int]]]:
    """The n-th example as it is, or so that the patterns and names that label spans no longer give them away."""
    if any(a < 0 or b > len(text) for a, _, b in spans):
        return text, spans
    kinds = [k for _, k, _ in spans]
    if kinds == ["secret"] and n % 2:
        return exchanged(text, *spans[0][::2])
    if n % 3 == 1:
        for a, kind, _ in reversed(spans):
            if kind == "phone":
                text = text[:a] + text[a + 1 :]
                spans = [(x - (x > a), k, y - (y > a)) for x, k, y in spans]
    elif n % 3 == 2 and kinds == ["card"]:
        a, _, b = spans[0]
        lead = f"{n % 97} "
        text, spans = text[:a] + lead + text[a:], [(a + len(lead), "card", b + len(lead))]
    if n % 3 and kinds == ["secret"]:
        a, _, b = spans[0]
        # a window that begins inside the name begins with it
        named, lead = next((m.start() for m in NAMED.finditer(text) if m.start(1) == a), 0), LEADS[n % len(LEADS)]
        text, spans = text[:named] + lead + text[a:b] + text[b + 1 :], [(named + len(lead), "secret", named + len(lead) + b - a)]
    if n % 5 == 4 and len(text.upper()) == len(text):
        text = text.upper()
    return text[:WINDOW], spans


def fit(examples: list[tuple[str, str]]) -> CharTagger | None:
    """A tagger from windows (text, spans as kind:start:end joined by commas); none without a labelled span."""
    if not any(spans for _, spans in examples):
        return None
    texts, tags = [], []
    for n, (text, joined) in enumerate(examples):
        text, spans = rewritten(n, text, [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in joined.split(",") if s)])
        texts.append(text)
        tags.append(tagged(len(text), spans) + [0] * (WINDOW - len(text)))
    return CharTagger(2 * len(TAGGED) + 1).train(padded(texts), np.array(tags), FIT_STEPS)


def labelled_spans(text: str) -> list[tuple[int, str, int]]:
    """The patterns' spans and named secrets."""
    named = [(m.start(1), "secret", m.end(1)) for m in NAMED.finditer(text) if valid("secret", m[1])]
    base = base_spans(text)
    return sorted(base + [x for x in named if all(x[2] <= a or b <= x[0] for a, _, b in base)])


def labelled_windows(text: str) -> list[tuple[str, str]]:
    """Windows around digits and @ with the labelled spans that lie in them, or reach into them (those begin before the window or end after it)."""
    found = labelled_spans(text)
    near = lambda s: [(a - s, k, b - s) for a, k, b in found if b > s and a < s + WINDOW]
    return [(text[s : s + WINDOW], ",".join(f"{k}:{a}:{b}" for a, k, b in near(s))) for s in windows(text)]


def training_windows(docs: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled windows (text, spans) of all documents, by hash of their text, none of their kinds more than a sixth of them."""

    share = max(1, most // 6)  # a task offers as many as the sample may take, so it doesn't depend on how rows are dealt

    def cut(batches):
        held: dict[str, dict[int, tuple[str, str]]] = {}
        for batch in batches:
            for text in texts_of(batch):
                for window in labelled_windows(text) if CUE.search(text) else ():
                    own = held.setdefault(",".join(sorted({x.split(":")[0] for x in window[1].split(",")})), {})
                    own[xxhash.xxh64_intdigest(window[0]) >> 1] = window
                    if len(own) > 2 * share:
                        for h in sorted(own)[share:]:
                            del own[h]
        for kinds, own in held.items():
            h = sorted(own)[:share]
            yield pa.RecordBatch.from_pydict({"kinds": [kinds] * len(h), "h": pa.array(h, pa.int64()), "text": [own[x][0] for x in h], "spans": [own[x][1] for x in h]})

    found = docs.select("text").mapInArrow(cut, "kinds string, h bigint, text string, spans string").distinct()
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("kinds").orderBy("h", "text", "spans"))).where(F.col("n") <= share)
    return ranked.orderBy("h", "text", "spans").select("text", "spans").limit(most)


def valid(kind: str, s: str) -> bool:
    if kind == "secret":
        return SECRET.fullmatch(s) is not None and DIGIT.search(s) is not None and not s.isdigit() and len(set(s)) >= 8
    if kind == "email":
        return emails(s) == [(0, len(s))]
    if kind == "phone":
        return is_phone(s) and re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", s) is not None and re.search(r"[\x20().-]", s) is not None
    return {"ip": is_ip, "card": is_card}[kind](s) and (kind == "ip" or CARD.fullmatch(s) is not None)


def whole(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a span is valid, and, for a secret, not a part of a longer run of its characters."""
    return valid(kind, text[a:b]) and (kind != "secret" or not (SECRET_END.search(text[max(0, a - 1) : a]) or SECRET_END.search(text[b : b + 1])))


def joined_paths(tagger: CharTagger, texts: list[str]):
    """(number of a text, where a stretch begins, tags, probabilities) of the stretches of texts that have a tag: overlapping windows, cut in the middle of what they share."""
    places = [(n, a, b, s) for n, t in enumerate(texts) for a, b in stretches(t) for s in windows_of(a, b)]
    tags = sure = None
    for k in range(0, len(places), 512):
        some = places[k : k + 512]
        paths, probabilities = (x.T for x in tagger.decode(padded([texts[n][s : min(s + WINDOW, b)] for n, _, b, s in some]).T))
        for (n, a, b, s), path, p in zip(some, paths, probabilities, strict=True):
            if s == a:
                tags, sure = np.zeros(b - a, np.int8), np.zeros(b - a, np.float32)
            low = s if s == a else s + (WINDOW - STRIDE) // 2
            high = min(s + WINDOW, b)  # what the next window knows better it writes over
            tags[low - a : high - a], sure[low - a : high - a] = path[low - s : high - s], p[low - s : high - s]
            if s + STRIDE >= max(a + 1, b - WINDOW + STRIDE) and tags.any():
                yield n, a, tags, sure


def secret_around(text: str, i: int, j: int) -> tuple[int, int]:
    """The run of a secret's characters that holds text[i:j]."""
    while i > 0 and SECRET_END.match(text[i - 1]):
        i -= 1
    while j < len(text) and SECRET_END.match(text[j]):
        j += 1
    return i, j


def added_spans(tagger: CharTagger, texts: list[str], base: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
    """Further spans of each text.

    A secret is a whole run of its characters, most of which have its tags: so one wrong tag in a long key, or where two windows meet, doesn't lose it.
    """
    found: list[list[tuple[float, int, str, int]]] = [[] for _ in texts]
    secret = 2 * TAGGED.index("secret")
    for n, a, tags, p in joined_paths(tagger, texts):
        text, i, done = texts[n], 0, 0
        set_at = np.flatnonzero(tags)
        while True:
            k = int(np.searchsorted(set_at, i))
            if k == len(set_at):
                break
            i = int(set_at[k])
            kind, j = (int(tags[i]) - 1) // 2, i + 1
            while j < len(tags) and tags[j] == 2 * kind + 2:
                j += 1
            if TAGGED[kind] == "secret":
                x, y = secret_around(text, a + i, a + j) if a + i >= done else (0, 0)
                own = slice(max(0, x - a), max(0, y - a))
                right = tags[own] > secret
                if y and right.mean() >= MOSTLY and p[own][right].mean() >= SURE and whole("secret", text, x, y):
                    found[n].append((-float(p[own][right].mean()), x, "secret", y))
                done = max(done, y)
            elif not ((i == 0 and a > 0) or (j == len(tags) and a + j < len(text))) and p[i:j].mean() >= SURE and whole(TAGGED[kind], text, a + i, a + j):
                found[n].append((-float(p[i:j].mean()), a + i, TAGGED[kind], a + j))
            i = j
    out = []
    for spans, own in zip(found, base, strict=True):
        taken = [(a, b) for a, _, b in own]
        kept = []
        for _, a, kind, b in sorted(set(spans)):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                kept.append((a, kind, b))
        out.append(kept)
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], TAGGED.index(x[1]))))


def find_private(docs: DataFrame, fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added of every row of docs (doc_id, text).

    The first numbers and the digest are of the patterns' spans; spans holds these and the tagger's, which n_added counts; n_secret counts the secrets among them. A null text is the empty text, without spans. Rows with a null
    or repeated doc_id have results of their own. Other columns are ignored, so their names cannot clash. An empty table gives an empty one; where the
    patterns find nothing there is nothing to learn and nothing is added. Whole texts are read; the tagger is fitted on at most `fit_windows` windows.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(trained(training_windows(docs, fit_windows), lambda rows: fit([(r["text"], r["spans"]) for r in rows])))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger.value, texts, base) if tagger.value else [[] for _ in texts]
            counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()),
                    pa.array([sum(k == "secret" for _, k, _ in m) for m in more], pa.int64()),
                    pa.array([len(m) for m in more], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_added"],
            )

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_secret bigint, n_added bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
