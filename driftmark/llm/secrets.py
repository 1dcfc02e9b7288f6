"""Secret scans: fixed patterns, and sliding-window entropy per alphabet, less words and placeholders."""

from __future__ import annotations

import math
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Kind, pattern, checked group and its least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Candidate strings.
HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{20,}|[0-9A-F]{20,})(?![A-Za-z0-9])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Kinds of entropy spans, and what a window holds: (lower, upper, digits, others), its kind and the entropy in bits
#: that it must reach. About 99% of the random windows over an alphabet do.
KINDS = ("entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_letters")
HEX_LEAST = 2.9
LIMITS = {(1, 0, 1, 0): ("entropy_lower", 3.4), (0, 1, 1, 0): ("entropy_upper", 3.34), (1, 1, 0, 0): ("entropy_letters", 3.58),
          (1, 0, 0, 0): ("entropy_letters", 3.2), (0, 1, 0, 0): ("entropy_letters", 3.2)}
OTHERS = ("entropy_base64", 3.64)
WINDOW = 20
#: Letters that a window has at least (random ones over these alphabets nearly always do).
LETTERS = 8
#: Strings that look random but are none: ids of known form and numbers as a whole, placeholders inside a window.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9_=+/-]+")
PLACEHOLDER = re.compile(r"EXAMPLE|example|xxxx|XXXX|0123456789|abcdefgh|ABCDEFGH")
#: Frequent letter pairs of European languages: most pairs of words and names, under a quarter of random ones.
PAIRS = frozenset((
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma "
    "si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow "
    "pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke ui ei ue au ck do da sc ft if af fa ah hr ff sp").split())
_LOG = [0.0] + [x * math.log2(x) for x in range(1, WINDOW + 1)]


def entropies(s: str, width=WINDOW):
    """Bits of entropy a character of each window of ``s``, from left to right.

    Counts of the window's characters change by one leaving and one entering character, and so does the sum
    of n log n: each step is constant work.
    """
    counts: dict[str, int] = {}
    total = 0.0
    log = _LOG if width == WINDOW else [0.0] + [x * math.log2(x) for x in range(1, width + 1)]
    for i, c in enumerate(s):
        if i >= width:
            gone = s[i - width]
            n = counts[gone]
            total -= log[n] - log[n - 1]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def _spans(places, width=WINDOW) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i in places:
        if out and out[-1][1] >= i:
            out[-1] = (out[-1][0], i + width)
        else:
            out.append((i, i + width))
    return out


def windows(s: str, least: float, width=WINDOW) -> list[tuple[int, int]]:
    """Merged spans of ``s`` whose windows reach ``least`` bits of entropy a character."""
    return _spans((i for i, e in enumerate(entropies(s, width)) if e >= least - 1e-9), width)


def _sums(flags) -> list[int]:
    return list(accumulate(flags, initial=0))


def _plain(s: str) -> list[bool]:
    """For each window of ``s`` whether it holds a whole placeholder, or mostly steps from a character to the next."""
    held = [False] * (len(s) - WINDOW + 1)
    for m in PLACEHOLDER.finditer(s):
        for i in range(max(0, m.end() - WINDOW), min(m.start() + 1, len(held))):
            held[i] = True
    step = _sums(ord(y) - ord(x) == 1 for x, y in zip(s, s[1:]))
    return [h or 2 * (step[i + WINDOW - 1] - step[i]) >= WINDOW for i, h in enumerate(held)]


def hex_windows(s: str) -> list[tuple[str, int, int]]:
    plain = _plain(s)
    return [("entropy_hex", a, b) for a, b in _spans(i for i, e in enumerate(entropies(s)) if e >= HEX_LEAST - 1e-9 and not plain[i])]


def run_windows(s: str) -> list[tuple[str, int, int]]:
    """Spans of ``s`` by kind: windows that reach the limit of the smallest alphabet that holds them, have letters
    enough, are no placeholder, and whose letter pairs aren't mostly those of words. Running sums keep each step
    constant."""
    held = [_sums(map(f, s)) for f in (str.islower, str.isupper, str.isdigit)]
    folded = s.lower()
    pair = [x + y for x, y in zip(folded, folded[1:])]
    letters, common = _sums(map(str.isalpha, pair)), _sums(p in PAIRS for p in pair)
    found: dict[str, list[int]] = {}
    plain = None
    for i, e in enumerate(entropies(s)):
        if e < 3.2 - 1e-9:
            continue
        lower, upper, digit = (h[i + WINDOW] - h[i] for h in held)
        kind, least = LIMITS.get((int(lower > 0), int(upper > 0), int(digit > 0), int(lower + upper + digit < WINDOW)), OTHERS)
        if e < least - 1e-9 or lower + upper < LETTERS:
            continue
        m, c = letters[i + WINDOW - 1] - letters[i], common[i + WINDOW - 1] - common[i]
        if m >= 8 and 2 * c > m:
            continue
        plain = _plain(s) if plain is None else plain
        if not plain[i]:
            found.setdefault(kind, []).append(i)
    return [(kind, a, b) for kind, places in found.items() for a, b in _spans(places)]


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points: those of the patterns, then high-entropy ones."""
    text = text or ""
    base = [(kind, m.start(), m.end()) for kind, p, group, least in PATTERNS for m in p.finditer(text)
            if m.end(group) - m.start(group) >= least]
    more = []
    for p, search in ((HEX, hex_windows), (RUN, run_windows)):
        for m in p.finditer(text):
            if not ALLOWED.fullmatch(m.group()):
                more += [(kind, m.start() + a, m.start() + b) for kind, a, b in search(m.group())]
    return base + more


def secret_spans(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row per document with its ``found`` spans (kind, start, end; code points, end exclusive).

    Null and empty texts have none, null ids are kept, each of repeated rows is searched. Spans of different
    kinds may overlap, those of one kind never do. Texts of any length are searched whole, in linear time.
    An empty table gives no rows. Only id and text are read, so other columns may have any name.
    """
    rank = {k: i for i, k in enumerate([p[0] for p in PATTERNS] + list(KINDS))}

    def make():
        def fn(texts):
            got = [sorted(find(t), key=lambda x: (x[1], rank[x[0]])) for t in texts.to_pylist()]
            return ([[dict(zip(("kind", "start", "end"), x)) for x in xs] for xs in got],)
        return fn

    return C.map_texts(docs, make, "found array<struct<kind:string,start:bigint,end:bigint>>", (key,), text)


def secret_table(docs: DataFrame, key="doc_id") -> DataFrame:
    """Counts and span lists of ``secret_spans``."""
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return secret_spans(docs, key).select(
        key, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(shown(of("assign", "access", "hex")), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mark="[SECRET]", text="text") -> DataFrame:
    """The same rows and columns with every span of a text replaced by ``mark`` (overlapping spans by one);
    n_chars, where there is one, follows. Nothing else changes; null texts stay null."""
    def make():
        def fn(texts):
            out = []
            for t in texts.to_pylist():
                at, parts = 0, []
                for a, b in sorted((a, b) for _, a, b in find(t)):
                    if b <= at:
                        continue
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = b
                out.append(t if t is None or not parts else "".join(parts) + t[at:])
            return (out,)
        return fn

    keep = [c for c in docs.columns if c != text]
    out = C.map_texts(docs, make, "__dm_clean string", keep, text).withColumnRenamed("__dm_clean", text)
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
