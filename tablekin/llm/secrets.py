r"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of word characters and single other signs. Each is tagged as secret begin, inside or
outside from its shape and those of two neighbours on each side (key words, and other words by a hash),
features of the whole text, and the tag before; Viterbi finds the best tags of a text. Tokens that no
tagging could gain by taking into a secret (their score for outside leads by more than any two
transitions can make up for) are outside for sure; the text is decoded between them, which
gives the same tags.

The field is trained in numpy on the surroundings of pattern matches in a sample of the documents, on as
many variants of them with secrets of other forms (``FORMS``), on text without matches, and on invented lines, every
other one with harmless things that look alike. A span is drawn out to the whole value it stands in, so that no piece
of one is left, and is added unless a pattern's match covers it; it may overlap one that covers a piece only.

Base patterns per kind, leftmost and without overlap: assign (key word, sign, value of 6 or more
characters), access (``AKIA...``, 20 or more), hex (24 or more digits). Spans are of whole
matches, in code points, end exclusive. Null and empty texts have no spans; repeated rows are scanned one
by one; an empty table trains on fixed examples alone; other columns are ignored.
"""

import bisect
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.llm.common import ROW, by_value, opened, released, shipped, small_batches, stage

shipped(__name__)

# fixed patterns and least lengths of the base kinds
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]

TOKEN = re.compile(r"\w+|[^\w\s]")
KEY_WORDS = ["password", "passwd", "pwd", "secret", "token", "api", "apikey", "api_key", "key", "auth", "bearer", "credential",
             "access", "private", "client", "login", "pass", "authorization", "sid", "webhook", "signature", "http", "https", "www"]
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SPAN = 2  # neighbours on each side
WORDS = 512  # words up to a length are told apart by a hash of so many values

SAMPLE_DOCUMENTS = 20_000  # documents that training looks at, at most
SAMPLE_SNIPPETS = 4_000  # snippets it learns from, at most
SNIPPET = 160  # characters on each side of a match
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.1, 1e-4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, in order."""
    spans = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _bucket(n: int) -> int:
    for at, limit in enumerate((1, 2, 4, 7, 11, 15, 19, 23, 31, 39)):
        if n <= limit:
            return at
    return 10


def shape(token: str) -> tuple:
    """What the field sees of a token; few different ones exist."""
    size = _bucket(len(token))
    if not token[0].isalnum() and token[0] != "_":
        return ("sign", token if token in "=:\"'/+-.,;@#$%&|<>(){}[]!?*\\`~^" else "other")
    word = token.lower()
    known = word if word in KEY_WORDS else next((f"{w}+" for w in KEY_WORDS[:9] if w in word), "") if len(word) < 24 else ""
    if token.isalpha():
        case = "lower" if token.islower() else "title" if token[1:].islower() or len(token) == 1 else "upper" if token.isupper() else "mixed"
        plain = "ascii" if token.isascii() else "wide"
        said = zlib.crc32(word.encode()) % WORDS if len(token) <= 14 and plain == "ascii" else WORDS
        return ("word", case, plain, size, known, min(4, len(set(token)) * 4 // len(token)) if size > 4 else 0, said)
    if token.isdigit():
        return ("digits", size)
    digits = sum(c.isdigit() for c in token)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    hexed = all(c in "0123456789abcdefABCDEF" for c in token)
    case = "lower" if token.islower() else "upper" if token.isupper() else "mixed"
    return ("code", case, "hex" if hexed else "any", size, known, min(turns, 6), digits * 4 // len(token))


def features(seen: tuple) -> list[str]:
    """The features of a shape: the whole (but for the word itself) and its parts."""
    return [repr(seen[:6] if seen[0] == "word" else seen), *[f"{seen[0]}.{i}={part}" for i, part in enumerate(seen)], f"{seen[0]}~{seen[1]}~{seen[2:4]}"]


def file_features(text: str) -> tuple[str, ...]:
    """Of the whole text: signs of code, of tables, and its length."""
    n = len(text) or 1
    return (f"code={min(3, (text.count('{') + text.count(';') + text.count('=')) * 400 // n)}",
            f"table={min(2, text.count('|') * 100 // n)}", f"size={min(5, n.bit_length() // 3)}")


# --- training -----------------------------------------------------------------------------

ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
NAMES = ["password", "PASSWORD", "secret", "token", "api_key", "pwd", "auth_token", "client_secret", "access_key", "Bearer", "private key",
         "dbpass", "DB_PASSWORD", "SECRET_ACCESS_KEY", "passphrase", "credential", "signing_key", "license_code", "key"]
SIGNS = [" = \"{}\"", "={}", ": {}", ": '{}'", " {}", " := {}", "=\"{}\""]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCHEMES = ["https", "postgres", "mysql", "amqp", "redis", "ftp", "mongodb"]


def _drawn(draw: random.Random, alphabet: str, sizes) -> str:
    return "".join(draw.choice(alphabet) for _ in range(draw.choice(sizes)))


def _assigned(draw: random.Random, value: str) -> tuple[str, int, int]:
    before, after = draw.choice(SIGNS).split("{}")
    head = draw.choice(NAMES) + before
    return head + value + after, len(head), len(head) + len(value)


def _plain_value(draw: random.Random):
    return _assigned(draw, _drawn(draw, draw.choice(ALPHABETS), [16, 20, 24, 32, 40, 48, 64]))


def _signed_value(draw: random.Random):
    """A value with signs of base64 and its kin among letters and digits."""
    extra = draw.choice(["+/", "-_", "-.", "+/.~"])
    value = _drawn(draw, ALPHABETS[2], [6, 9]) + _drawn(draw, ALPHABETS[2] + extra, [18, 28, 38, 52])
    return _assigned(draw, value + draw.choice(["", "", "=", "=="]))


def _prefixed_value(draw: random.Random):
    """A value that says by a prefix what it is, with a key word before it or none."""
    joint = draw.choice("-_")
    parts = [_drawn(draw, LETTERS, [2, 3, 4, 5]) for _ in range(draw.choice([1, 1, 2]))]
    if draw.random() < 0.3:
        parts.append(_drawn(draw, "0123456789", [8, 10, 12]))
    value = joint.join([*parts, _drawn(draw, ALPHABETS[2], [24, 32, 36, 40, 48])])
    return _assigned(draw, value) if draw.random() < 0.4 else (value, 0, len(value))


def _dotted_value(draw: random.Random):
    """Three long parts with dots between, the first two beginning alike."""
    parts = ["ey" + _drawn(draw, ALPHABETS[2], [18, 34, 70]) for _ in range(2)]
    value = ".".join([*parts, _drawn(draw, ALPHABETS[2] + "-_", [32, 43])])
    return _assigned(draw, value) if draw.random() < 0.7 else (value, 0, len(value))


def _password_in_url(draw: random.Random):
    head = f"{draw.choice(SCHEMES)}://{_drawn(draw, LETTERS, [4, 5, 7])}:"
    value = _drawn(draw, ALPHABETS[2], [8, 10, 12, 16, 20])
    host = f"@{_drawn(draw, LETTERS, [4, 6, 8])}.{_drawn(draw, LETTERS, [3, 5])}"
    return head + value + host + draw.choice(["", ":5432", "/main"]), len(head), len(head) + len(value)


def _short_value(draw: random.Random):
    """A short password, letters and at least one digit."""
    value = _drawn(draw, ALPHABETS[2], [6, 7, 8, 9, 11]) + draw.choice("0123456789") + _drawn(draw, ALPHABETS[2], [1, 2])
    head = draw.choice(["pwd", "pass", "password", "passwd", "PWD", "dbpass", "login"]) + draw.choice(["=", ": ", " = ", " := ", ":"])
    return head + value, len(head), len(head) + len(value)


FORMS = {"plain": _plain_value, "signed": _signed_value, "prefixed": _prefixed_value, "dotted": _dotted_value, "url": _password_in_url,
         "short": _short_value}


def _invented(draw: random.Random) -> tuple[str, int, int]:
    """A text with a random secret of some form; start and end of the secret."""
    return FORMS[draw.choice(sorted(FORMS))](draw)


def _harmless(draw: random.Random) -> str:
    """What looks like a secret to a reader of shapes and is none."""
    word = lambda: _drawn(draw, LETTERS, [3, 4, 5, 6, 8, 11])
    number = lambda *sizes: _drawn(draw, "0123456789", sizes)
    hexed = lambda n: _drawn(draw, ALPHABETS[draw.choice([0, 1])], [n])
    return draw.choice([
        lambda: "-".join(hexed(n) for n in (8, 4, 4, 4, 12)),
        lambda: "/".join(["", *[word() for _ in range(draw.randint(2, 5))]]) + draw.choice([".py", ".txt", "", ".tar.gz"]),
        lambda: f"{draw.choice(SCHEMES)}://{word()}.{word()}.com/{word()}/{word()}-{number(2, 4)}?{word()}={number(1, 5)}",
        lambda: f"{draw.choice(SCHEMES)}://{word()}.{word()}:{number(4)}/{word()}",
        lambda: f"{word()}.{word()}{number(2)}@{word()}.com",
        lambda: "_".join(word() for _ in range(draw.randint(2, 4))) + draw.choice(["", f"_{number(1, 4)}", "()"]),
        lambda: "".join(word().title() for _ in range(draw.randint(2, 5))),
        lambda: "-".join(word() for _ in range(draw.randint(2, 5))),
        lambda: f"{word()}-{number(1)}.{number(1, 2)}.{number(1)}", lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}:{number(2)}Z",
        lambda: f"{draw.choice(NAMES)} {word()} {word()}", lambda: f"{word()} = {word()}", lambda: f"{word()}: {word()} {word()}",
        lambda: f"{word()}={number(1, 3, 8)}", lambda: f"{draw.choice(['id', 'sha', 'commit', 'checksum', 'build'])} {hexed(draw.choice([7, 8, 12, 16, 40]))}",
        lambda: f"{word()}{number(1, 2, 4)}{word()}", lambda: f"the {draw.choice(NAMES)} of the {word()} is kept", lambda: f"+{number(2)} {number(3)} {number(4)} {number(3)}",
    ])()


def _value(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    if kind == 0:
        m = ASSIGN.match(text, start, end)
        return (m.start(2), m.end(2)) if m else (start, end)
    return start, end


SNIPPETS = "at long, text string, marks array<int>, file array<string>"


def _snippets(batches):
    """Surroundings of matches, of a variant of each, and a plain piece of every tenth text."""
    for batch in batches:
        out = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            at = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
            draw, file = random.Random(at), list(file_features(text))
            spans = base_spans(text)
            for start, kind, end in spans[:2]:
                a, b = max(0, start - SNIPPET), min(len(text), end + SNIPPET)
                marks = [m - a for s in spans if s[0] >= a and s[2] <= b for m in _value(text, *s)]
                out.append((at, text[a:b], marks, file))
                said, v, w = _invented(draw)
                out.append((at + 1, text[a:start] + said + text[end:b], [start - a + v, start - a + w], file))
            if not spans and at % 10 == 0 and text:
                a = draw.randrange(max(1, len(text) - 2 * SNIPPET))
                out.append((at, text[a:a + 2 * SNIPPET], [], file))
        yield pa.RecordBatch.from_pydict(
            {name: [row[i] for row in out] for i, name in enumerate(("at", "text", "marks", "file"))},
            pa.schema([("at", pa.int64()), ("text", pa.string()), ("marks", pa.list_(pa.int32())), ("file", pa.list_(pa.string()))]))


FIXED = 1_200


def _fixed_examples() -> list[tuple]:
    """Examples that training has even without documents: secrets, and in every other one harmless things only."""
    draw = random.Random(1)
    words = ["the", "value", "of", "this", "setting", "is", "kept", "in", "a", "file", "for", "users", "and", "named", "Report", "2024", "use", "set",
             "with", "see", "export", "curl", "from", "at", "Authorization", ":", "-H", "config", "then", "it", "was", "by", "them", "(", ")", ",", ";"]

    def some() -> str:
        return " ".join(_harmless(draw) if draw.random() < 0.15 else draw.choice(words) for _ in range(draw.randint(1, 12)))

    out = []
    for at in range(FIXED):
        head = some() + draw.choice([" ", " ", "\n", " \"", " '"])
        said, a, b = _invented(draw) if at % 2 else (_harmless(draw), 0, 0)
        text = head + said + draw.choice([" ", "\n", ". ", "\" ", "' "]) + some()
        marks = [len(head) + a, len(head) + b] if at % 2 else []
        out.append((at, text, marks, list(file_features(text))))
    return out


class Field:
    """Weights of features per neighbour offset and tag, of text features, and of tag pairs."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.own = np.zeros((2 * SPAN + 1, len(names) + 1, 3))  # the last feature is unknown
        self.file = np.zeros((len(names) + 1, 3))
        self.pair = np.zeros((3, 3))  # of a tag after another
        self.first = np.zeros(3)

    def ids(self, seen: tuple) -> list[int]:
        return [self.names.get(name, len(self.names)) for name in features(seen)]

    def rows(self, seen: tuple) -> np.ndarray:
        """Scores that a token of this shape gives to the tags of its neighbours."""
        return self.own[:, self.ids(seen)].sum(1)

    def file_row(self, file) -> np.ndarray:
        return self.file[[self.names.get(name, len(self.names)) for name in file]].sum(0)


def _softmax_sum(a: np.ndarray, axis: int) -> np.ndarray:
    most = a.max(axis, keepdims=True)
    return (most + np.log(np.exp(a - most).sum(axis, keepdims=True))).squeeze(axis)


def _tags(text: str, marks: list[int]) -> tuple[list[tuple], list[int]]:
    seen, tags = [], []
    spans = list(zip(marks[::2], marks[1::2]))
    for m in TOKEN.finditer(text):
        inside = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        tags.append(OUTSIDE if inside is None else BEGIN if m.start() <= inside[0] else INSIDE)
        seen.append(shape(m[0]))
    return seen, tags


def train(examples: list[tuple]) -> Field:
    """A field by stochastic gradient (adaptive steps) on the likelihood of the tags."""
    made = [(*_tags(text, list(marks)), list(file)) for _, text, marks, file in examples]
    made = [one for one in made if one[0]]
    names: dict[str, int] = {}
    for seen, _, file in made:
        for name in [n for s in set(seen) for n in features(s)] + file:
            names.setdefault(name, len(names))
    field = Field(names)
    width = max((len(features(s)) for seen, _, _ in made for s in seen), default=1)
    known = {}
    pad = [len(names)] * width
    for seen, _, _ in made:
        for s in seen:
            known.setdefault(s, (field.ids(s) + pad)[:width])
    parameters = [field.own, field.file, field.pair, field.first]
    squares = [np.full_like(p, 1e-3) for p in parameters]
    draw = random.Random(3)
    order = list(range(len(made)))
    for _ in range(EPOCHS):
        draw.shuffle(order)
        for low in range(0, len(order), BATCH):
            part = sorted((made[i] for i in order[low:low + BATCH]), key=lambda one: len(one[0]))
            gradients = _gradient(field, part, known, width)
            for p, g, s in zip(parameters, gradients, squares):
                g -= DECAY * len(part) * p
                s += g * g
                p += RATE * g / np.sqrt(s)
            field.own[:, -1] = 0
            field.file[-1] = 0
    return field


def _gradient(field: Field, part: list[tuple], known: dict, width: int):
    n, longest = len(part), max(len(one[0]) for one in part)
    none = len(field.names)
    ids = np.full((n, longest + 2 * SPAN, width), none)
    tags, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    files = np.full((n, max(len(one[2]) for one in part)), none)
    for i, (seen, tag, file) in enumerate(part):
        ids[i, SPAN:SPAN + len(seen)] = [known[s] for s in seen]
        tags[i, :len(tag)], mask[i, :len(tag)] = tag, True
        files[i, :len(file)] = [field.names[name] for name in file]
    score = field.file[files].sum(1)[:, None, :] + np.zeros((n, longest, 3))
    for offset in range(2 * SPAN + 1):
        score += field.own[offset, ids[:, offset:offset + longest]].sum(2)
    # forward and backward sums; past the end of a text nothing changes
    ahead = np.zeros((n, longest, 3))
    ahead[:, 0] = field.first + score[:, 0]
    for t in range(1, longest):
        step = _softmax_sum(ahead[:, t - 1, :, None] + field.pair, 1) + score[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    back = np.zeros((n, longest, 3))
    for t in range(longest - 2, -1, -1):
        step = _softmax_sum(field.pair + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    total = _softmax_sum(ahead[:, -1], 1)
    expected = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
    miss = np.eye(3)[tags] * mask[:, :, None] - expected
    own, file = np.zeros_like(field.own), np.zeros_like(field.file)
    for offset in range(2 * SPAN + 1):
        at = ids[:, offset:offset + longest].reshape(-1, width)
        for tag in range(3):
            own[offset, :, tag] = np.bincount(at.ravel(), np.repeat(miss[:, :, tag].ravel(), width), none + 1)
    np.add.at(file, files, miss.sum(1)[:, None, :])
    both = mask[:, 1:]
    pairs = np.exp(ahead[:, :-1, :, None] + field.pair + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
    pair = -(pairs * both[:, :, None, None]).sum((0, 1))
    np.add.at(pair, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    return own, file, pair, miss[:, 0].sum(0)


# --- decoding -----------------------------------------------------------------------------


def viterbi(score: np.ndarray, field: Field, first: np.ndarray, last: np.ndarray) -> list[int]:
    """The best tags of a stretch; ``first`` and ``last`` score its ends."""
    best, came = score[0] + first, []
    for row in score[1:]:
        ways = best[:, None] + field.pair
        came.append(ways.argmax(0))
        best = ways.max(0) + row
    tag = int((best + last).argmax())
    tags = [tag]
    for step in reversed(came):
        tag = int(step[tag])
        tags.append(tag)
    return tags[::-1]


BATCH_ROWS = 1_000  # rows whose texts are made at once


class Shapes(dict):
    """Token to the row of its shape; shapes are few, tokens are forgotten now and then."""

    MOST = 100_000

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.shapes, self.scores = field, {}, np.zeros((64, 2 * SPAN + 1, 3))

    def __missing__(self, token: str) -> int:
        seen = shape(token)
        at = self.shapes.get(seen)
        if at is None:
            at = self.shapes[seen] = len(self.shapes)
            if at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at] = self.field.rows(seen)
        if len(self) >= self.MOST:
            self.clear()
        self[token] = at
        return at


def token_scores(tokens: list[str], file_row: np.ndarray, shapes: Shapes) -> np.ndarray:
    at = np.fromiter(map(shapes.__getitem__, tokens), np.int64, len(tokens))
    table = shapes.scores
    score = np.tile(file_row, (len(at), 1))
    for offset in range(-SPAN, SPAN + 1):
        # the token at t + offset speaks for the tag at t
        low, high = max(0, -offset), min(len(at), len(at) - offset)
        if low < high:
            score[low:high] += table[at[low + offset:high + offset], offset + SPAN]
    return score


def field_spans(text: str, field: Field, shapes: Shapes) -> list[tuple[int, int]]:
    """Start and end of what the field takes for secrets."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    score = token_scores(tokens, field.file_row(file_features(text)), shapes)
    slack = 2 * (max(field.pair.max(), field.first.max()) - min(field.pair.min(), field.first.min()))
    unsure = np.flatnonzero(score[:, OUTSIDE] - score[:, 1:].max(1) <= slack)
    if not len(unsure):
        return []
    places, spans = None, []
    for run in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
        a, b = int(run[0]), int(run[-1])
        tags = viterbi(score[a:b + 1], field, field.pair[OUTSIDE] if a else field.first,
                       field.pair[:, OUTSIDE] if b + 1 < len(tokens) else np.zeros(3))
        if not any(tags):
            continue
        places = places or [m.span() for m in TOKEN.finditer(text)]
        for t, tag in enumerate(tags, a):
            if tag == BEGIN or tag == INSIDE and (t == a or tags[t - a - 1] == OUTSIDE):
                spans.append(list(places[t]))
            elif tag == INSIDE:
                spans[-1][1] = places[t][1]
    return [tuple(span) for span in spans]


INSIDE_VALUE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.~-")
PADDING = "="


def whole_values(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn out to the whole run of characters of a value they stand in, so that no piece of one is left.

    A run ends at white space, quotes, brackets, ``:`` or ``=``, but takes in ``=`` that pads its end.
    Where it begins like a path, only what follows the last ``/`` before the span is taken. Spans that meet become one.
    """
    out, done = [], 0
    for start, end in spans:
        if start < done:
            if end <= done:
                continue
            start = done
        a, b = start, max(end, start)
        while a > done and text[a - 1] in INSIDE_VALUE:
            a -= 1
        if text[a] == "/":
            a = text.rfind("/", a, start) + 1 or start
        while b < len(text) and text[b] in INSIDE_VALUE:
            b += 1
        while b > end and text[b - 1] in ".-/":  # ends of sentences
            b -= 1
        for _ in range(2):
            b += text[b:b + 1] == PADDING
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
        done = out[-1][1]
    return out


def all_spans(text: str, field: Field, shapes: Shapes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base matches and of the field's whole values that no base match covers."""
    base = base_spans(text)
    if not base:
        return [(a, 3, b) for a, b in whole_values(text, field_spans(text, field, shapes))]
    reach, starts = list(itertools.accumulate((end for _, _, end in base), max)), [start for start, _, _ in base]
    added = []
    for a, b in whole_values(text, field_spans(text, field, shapes)):
        at = bisect.bisect_right(starts, a)
        # matches that begin at or before the span; what they leave of it is still a secret
        if not at or reach[at - 1] < b:
            added.append((a, 3, b))
    return sorted(base + added)


def fit(docs: DataFrame) -> Field:
    """A field from the documents, whichever a hash of their texts picks; copies count once."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    picked = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    with small_batches(docs.sparkSession):
        snippets = picked.distinct().mapInArrow(released(_snippets), SNIPPETS).orderBy("at", "text").limit(SAMPLE_SNIPPETS).toArrow()
    columns = [snippets.column(name).to_pylist() for name in ("at", "text", "marks", "file")]
    return train(list(zip(*columns)) + _fixed_examples())


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and the number of added spans."""
    shared = by_value(docs.sparkSession, fit(docs))

    def run(batches):
        field = opened(shared)
        shapes = Shapes(field)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                spans = all_spans(text.as_py() or "", field, shapes)
                kinds = [kind for _, kind, _ in spans]
                base = hashlib.sha256(_told([s for s in spans if s[1] < 3]).encode()).hexdigest()
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), base, _told(spans), kinds.count(3)))
            names = [field_.split(" ")[0] for field_ in REPORT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), REPORT)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows with their columns; found values are replaced in text, and n_chars (if any) follows.

    The rows are kept as a stage, so that no reader's settings decide how much text a task holds.
    """
    shared = by_value(docs.sparkSession, fit(docs))

    def clean(text: str | None, field: Field, shapes: Shapes) -> str | None:
        pieces, at = [], 0
        for start, kind, end in all_spans(text, field, shapes) if text else []:
            start, end = _value(text, start, kind, end)
            if start >= at:
                pieces += [text[at:start], mark]
            at = max(at, end)
        return "".join([*pieces, text[at:]]) if pieces else text

    def run(batches):
        field = opened(shared)
        shapes = Shapes(field)
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(low, BATCH_ROWS)
                made = [clean(text.as_py(), field, shapes) for text in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(made, pa.string())], [ROW, "text"])

    # the text goes to Python once, the other columns beside it
    others = [F.col(f"`{field.name}`") for field in docs.schema if field.name != "text" and field.dataType != T.NullType()]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_none")).alias(ROW), "text")
    with small_batches(docs.sparkSession):
        cleaned = stage(rows.mapInArrow(released(run), rows.schema))
    columns = []
    for field in docs.schema:
        column = F.col(f"{ROW}.`{field.name}`") if field.name != "text" else F.col("text")
        if field.dataType == T.NullType():  # Parquet holds no such column
            column = F.lit(None)
        if field.name == "n_chars":
            column = F.char_length(F.coalesce("text", F.lit(""))).cast(field.dataType)
        columns.append(column.alias(field.name))
    return cleaned.select(*columns)
