"""Secret scan: base patterns and dictionary-primed zstandard novelty.

The base patterns find assignments, access keys and hexadecimal strings. Beyond them, every run
of 12 and more characters without blanks and quotes that stands near a sensitive word is a candidate.
A compressor primed with identifiers, prose, common forms and the text around the candidate measures
how many bytes the candidate adds to a text: names, words, dates and repeated values are cheap. What it
adds is held against what random strings of the same shape add: the same marks, and other letters and
digits of its kinds. A candidate that adds nearly as much, and overlaps no base span, is reported as
kind ``novel``.

A document is judged by itself where it is read; nothing is shuffled.
"""

import functools
import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from newstide.llm.common import row_of, row_udf

# The base patterns with their shortest length, in the order of the contract. For
# hexadecimal runs the length is part of the pattern, which finds the same runs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "novel")

# Words that make their surroundings sensitive, and identifiers that prime the
# compressor.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key",
             "access_key", "private_key", "credential", "bearer", "authorization", "client_id",
             "signature", "session", "cookie", "akia", "auth_", "pwd")
IDENTIFIERS = ("access account action address admin alias algorithm application argument array "
               "attribute authorization backup base64 boolean bucket buffer callback certificate "
               "client column command comment config configuration connection console constant "
               "container content context cookie counter credential database default definition "
               "delete description development directory document domain element encoding "
               "endpoint environment error example exception execute expires export expression "
               "false filename filter format function generate handler header hostname https "
               "identifier import index information instance integer interface internal language "
               "length library localhost location manager message metadata method middleware "
               "module network number object operation option output package parameter password "
               "pattern permission placeholder platform port private process production profile "
               "project property protocol provider public query redirect reference register "
               "release repository request resource response result return schema secret security "
               "select sequence server service session settings signature source statement static "
               "status storage string structure submit system table target template timeout "
               "timestamp token transaction true undefined update upload username utf-8 value "
               "variable version www your_api_key_here changeme xxxxxxxx 0123456789 abcdefghij "
               "klmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 0000000000")

# Ordinary sentences, for the letters of words, and forms that values often have.
PROSE = (
    "the committee of the house was not able to agree on which of these questions they would like to "
    "put before their members when it meets again this week; nothing about the weather on either side "
    "of the river had changed, although everyone there thought that something ought to happen; she "
    "wrote down what he had been saying, which was rather more interesting than the information given "
    "by their government; "
    "die meisten menschen haben noch nicht verstanden, dass sich ihre wirtschaftliche lage durch eine "
    "solche entscheidung nur wenig verbessern wird; durch die verschiedenen einrichtungen der "
    "gesellschaft werden wichtige veranstaltungen nach möglichkeit gemeinsam durchgeführt, und auch die "
    "beziehungen zwischen den beteiligten unternehmen sollten sich dadurch erheblich verändern; "
    "les habitants de la ville ont toujours souhaité que leurs représentants puissent répondre aux "
    "questions qui les concernent directement; cette organisation internationale cherche depuis "
    "plusieurs années à améliorer l'enseignement et les conditions de travail, mais beaucoup de "
    "personnes pensent que les changements viendront seulement avec le temps; "
    "los ciudadanos quieren saber cuándo empezarán las obras del puente y quiénes van a pagar por ellas "
    "durante el año; la administración pública tiene que responder a las necesidades de la población, "
    "porque muchas personas trabajadoras necesitan una explicación sobre los cambios que se hicieron "
    "entonces en aquellas ciudades; ")
FORMS = ("john.smith@example.com maria_garcia99@mail.example.org info@company.net /home/user/projects/ "
         "/usr/local/lib/python3.11/site-packages/ src/main/java/com/example/ c:\\users\\public\\documents "
         "https://www.example.com/news/2024/01/15/index.html?page=2&id= http://localhost:8080/api/v1/users "
         "2023-12-31T23:59:59Z 2024-01-15T10:23:45.000+00:00 build-artifacts-2023.tar.gz "
         "report_final_v2.pdf image.png data.json.gz 192.168.0.1:5432 10.0.0.255 +1-555-0123 "
         "version-1.10.3-beta.2 x86_64-linux-gnu node_modules/@types ")
# Sentences of rare words that a candidate is put behind, so that what it adds is measured inside a
# block; their lengths differ, which evens out that only whole bytes can be seen.
CARRIERS = ("quoth my jovial wizard, vexing fjord bank glyphs; kept up waxy",
            "big fjords vex quick waltz nymph; zephyrs pack my box of jugs,",
            "how vexingly quick daft zebras jump over my lazy foxglove bank")

# A candidate: a maximal run of ASCII characters that are neither blanks nor quotes; how near to a
# sensitive word it is, on either side, and how much of the text around it primes.
_RUN = "[!#-&(-_a-~]"
CANDIDATE = re.compile(_RUN + "{12,}")
_OUTSIDE = re.compile("[^!#-&(-_a-~]")
_EDGE = ".,;:()[]{}<>"
_KEY_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY[A-Z ]*)-----")
# Lines of a key, which may be written with escaped line ends: header fields and base64.
_KEY_LINES = re.compile(r"(?:(?:\s|\\[nr])*+(?:[A-Za-z-]++: [^\n]*+\n|[A-Za-z0-9+/=]{16,}+))*+")
# The last line may be short; it stands alone.
_KEY_REST = re.compile(r"(?:\r?\n|\\n)[A-Za-z0-9+/=]{1,15}(?=\r?\n|\\n|\Z)")
_KEY_END = re.compile(r"(?:\s|\\[nr])*+[A-Za-z0-9+/=]*+(?:\s|\\[nr])*+-----END ([A-Z0-9 ]*)-----")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
NEAR, AROUND = 64, 512
# Marks that join the parts of names, paths, dates and addresses. Random strings have few of them, so
# a candidate with one in every SPARSE characters is judged by its parts alone.
_SEPARATORS = re.compile(r"[-_./:@?=&,;~|\\()\[\]{}<>]+")
LEAST, SPARSE = 12, 8
# Share of what random strings of its shape add that a candidate has to add. Letters in the case of a
# word, or of a name of words and numbers, have to add more, as words of other vocabularies come near
# to the lower bound.
NOVELTY, WORD_NOVELTY, NAME_NOVELTY = 0.78, 0.93, 1.02
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_NAME_PARTS = re.compile(r"[A-Z]{2,}(?![a-z])|[A-Z]?[a-z]+|[A-Z]|[0-9]+")
NAME_LETTERS, NAME_DIGITS = 4, 4
# Rows of one mark that a word is followed by belong to no value.
_TRAIL = re.compile(r"([^A-Za-z0-9])\1+\Z")
# How often parts of the dictionary are shown to the compressor's own tables, words and other forms;
# random strings per shape, of shapes up to LONG and beyond; how many shapes are remembered.
SHOWN_WORDS, SHOWN_FORMS, RANDOM, RANDOM_LONG, LONG, SHAPES = 10, 3, 16, 3, 128, 4096

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base matches, by start and then kind as listed."""
    lowered = text.lower()
    found: list[Span] = []
    # the letters of each keyword survive lower(), so a text without any has no assignment
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= ASSIGN_LENGTH]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)
              if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _sensitive_windows(text: str, near: int) -> Iterator[tuple[int, int]]:
    """Where candidates are looked for: around each sensitive word, merged where they overlap."""
    start = end = -1
    for word in _SENSITIVE.finditer(text):
        if word.start() - near > end:
            if end >= 0:
                yield start, end
            start = max(word.start() - near, 0)
        end = word.end() + near
    if end >= 0:
        yield start, end


class Novelty:
    """Marginal compressed bytes of strings, given identifiers and their surroundings.

    ``near`` is how far a candidate may be from a sensitive word, ``around`` how much of the text on
    either side of it primes. The compressor codes single letters by how often they occur, not pairs,
    so every text goes through ``folded`` first: lower case, and in place of each letter its rank
    among those that follow the letter before it in the dictionary. What repeats still does, and
    letters of words become few.
    """

    def __init__(self, identifiers: str = IDENTIFIERS, near: int = NEAR, around: int = AROUND,
                 level: int = 19):
        import zstandard

        self.zstd, self.level, self.near, self.around = zstandard, level, near, around
        words = f"{PROSE}{identifiers} ".lower()
        letters = string.ascii_lowercase
        pairs, alone = Counter(zip(" " + words, words)), Counter(words)
        self.rank = {}
        for before in " " + letters:
            after = sorted(letters, key=lambda c: (-pairs[before, c], -alone[c], c))
            self.rank |= {(before, c): letters[i] for i, c in enumerate(after)}
        parts = f"{words}{FORMS}".split()
        shown = [self.folded(w + " ").encode() for w in parts if w.isalpha()] * SHOWN_WORDS
        shown += [self.folded(w).encode() for w in parts if not w.isalpha()] * SHOWN_FORMS
        # the tables of the coder and the least of content; all of it follows
        tables = zstandard.train_dictionary(512, shown, level=level).as_bytes()
        self.content = tables + self.folded(f"{PROSE}{FORMS}{identifiers} ").encode()
        self.carriers = [self.folded(c).encode() for c in CARRIERS]
        self.bare = self._primed("")
        self._of_shape = functools.lru_cache(SHAPES)(self._random_bytes)

    def folded(self, text: str) -> str:
        text = text.lower()
        before = " " + "".join(c if "a" <= c <= "z" else " " for c in text)
        return "".join(self.rank.get(pair, pair[1]) for pair in zip(before, text))

    def _primed(self, around: str):
        """The measure of strings in these surroundings."""
        data = self.content + self.folded(around).encode()
        params = self.zstd.ZstdCompressionParameters.from_level(
            self.level, source_size=256, dict_size=len(data), write_content_size=False,
            write_checksum=False, write_dict_id=False)
        prime = self.zstd.ZstdCompressionDict(data, dict_type=self.zstd.DICT_TYPE_FULLDICT)
        prime.precompute_compress(compression_params=params)
        tool = self.zstd.ZstdCompressor(compression_params=params, dict_data=prime)
        empty = [len(tool.compress(c)) for c in self.carriers]

        def added(value: str) -> float:
            data = self.folded(value).encode()
            carriers = self.carriers if len(value) <= LONG else self.carriers[:1]
            return sum(len(tool.compress(c + data)) - n for c, n in zip(carriers, empty)) / len(carriers)

        return added

    def bytes_added(self, value: str, around: str) -> float:
        return self._primed(around)(value)

    def _random_bytes(self, kinds: str, shape: str) -> float:
        """What random strings of a shape add on average; \0 in the shape stands for one of ``kinds``."""
        draw = random.Random(f"{kinds}{shape}")
        n = RANDOM if len(shape) <= LONG else RANDOM_LONG
        strings = ("".join(draw.choice(kinds) if c == "\0" else c for c in shape) for _ in range(n))
        return sum(map(self.bare, strings)) / n

    def random_bytes(self, value: str) -> float:
        """Bytes that random strings of this one's marks and kinds of letters and digits add."""
        seen = {c for c in value if c.isalnum()}
        kinds = "".join(kind for kind in (string.ascii_lowercase, string.ascii_uppercase, string.digits)
                        if not seen.isdisjoint(kind))
        if seen <= set(string.hexdigits) and len(kinds) > len(string.ascii_lowercase):
            kinds = "0123456789abcdef"
        shape = "".join("\0" if c.isalnum() else c for c in value)
        return (self._of_shape if len(value) <= LONG else self._random_bytes)(kinds or "-", shape)

    def is_novel(self, value: str, around: str) -> bool:
        least = (WORD_NOVELTY if _WORD.fullmatch(value) else
                 NAME_NOVELTY if _is_name(value) else NOVELTY)
        return self.bytes_added(value, around) >= least * self.random_bytes(value)


def _is_name(value: str) -> bool:
    """Words of ``NAME_LETTERS`` letters and more on average, in any case, joined or apart, and each
    part between separators with one short number at most, at its end."""
    letters = words = 0
    for part in _SEPARATORS.split(value):
        found = _NAME_PARTS.findall(part)
        if sum(map(len, found)) < len(part):
            return False
        if found and found[-1].isdigit() and len(found[-1]) <= NAME_DIGITS:
            found.pop()
        if any(one.isdigit() for one in found):
            return False
        letters, words = letters + sum(map(len, found)), words + len(found)
    return letters >= NAME_LETTERS * words > 0


def _key_blocks(text: str) -> Iterator[Span]:
    """Private keys: a head, lines of a key, and the foot of the same label if it follows these.

    A head that no line of a key follows is a mention and no key."""
    at = 0
    while head := _KEY_BLOCK.search(text, at):
        at = _KEY_LINES.match(text, head.end()).end()
        foot = _KEY_END.match(text, at)
        rest = _KEY_REST.match(text, at) if at > head.end() else None
        if foot and foot[1] == head[1]:
            at = foot.end()
        elif rest:
            at = rest.end()
        if at > head.end():
            yield head.start(), at, "novel"


def _is_secret(value: str, around: str, novelty: Novelty) -> bool:
    """A run counts as a whole, by what follows the sensitive words or the = in it, or by a part.

    What is judged has ``LEAST`` characters, two thirds of these letters or digits, and few
    separators, see ``SPARSE``."""
    value = _TRAIL.sub("", value)
    rests = {value, value.rpartition("=")[2], _SENSITIVE.split(value)[-1].strip("-_=:")}
    judged = {rest for rest in rests
              if sum(map(len, _SEPARATORS.findall(rest))) * SPARSE < len(rest)}
    judged.update(_SEPARATORS.split(value))
    return any(sum(map(str.isalnum, one)) >= LEAST * 2 // 3 and len(one) >= LEAST
               and novelty.is_novel(one, around) for one in sorted(judged))


def novel_spans(text: str, known: Iterable[Span], novelty: Novelty) -> list[Span]:
    """Key blocks, and incompressible candidates in sensitive surroundings that overlap no known
    span; of a run that does, what lies outside is a candidate."""
    found = list(_key_blocks(text))
    taken = sorted([(start, end) for start, end, _ in known] + [s[:2] for s in found])
    reached = 0
    at = 0
    for left, right in _sensitive_windows(text, novelty.near):
        begin = max(left, reached)
        while begin > reached and not _OUTSIDE.match(text, begin - 1):
            begin -= 1
        for m in CANDIDATE.finditer(text, begin):
            start, stop = m.span()
            if start >= right:
                break
            reached = stop
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            free, k = [], at
            while k < len(taken) and taken[k][0] < stop:
                free.append((start, taken[k][0]))
                start, k = max(start, taken[k][1]), k + 1
            for start, end in [*free, (start, stop)]:
                run = text[start:end]
                start += len(run) - len(run.lstrip(_EDGE))
                run = run.strip(_EDGE)
                end = start + len(run)
                around = (text[max(start - novelty.around, 0):start]
                          + text[end:end + novelty.around])
                if len(run) >= LEAST and _is_secret(run, around, novelty):
                    found.append((start, end, "novel"))
    return found


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_spans(text: str, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the novel ones among them."""
    base = base_spans(text)
    spans = sorted(base + novel_spans(text, base, novelty),
                   key=lambda s: (s[0], KINDS.index(s[2])))
    return base, spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR,
                 around: int = AROUND) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    ``spans`` is kind:start:end in code points, the end exclusive, by start and then kind, joined by
    commas; ``base_sha256`` is the digest of the same of the base spans alone. Null and empty texts
    have none. Whole texts are read, repeated rows each; an empty table gives an empty result.
    ``near`` and ``around`` are those of ``Novelty``.
    """
    def make():
        novelty = Novelty(near=near, around=around)

        def one(text):
            base, spans = find_spans(text or "", novelty)
            kinds = [kind for _, _, kind in spans]
            return (*[kinds.count(kind) for kind in KINDS],
                    hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
        return one

    schema = (", ".join(f"n_{kind} bigint" for kind in KINDS)
              + ", base_sha256 string, spans string")
    return (docs.select(docs[id_col].alias("doc_id"),
                        row_udf(schema, make)(docs[text_col]).alias("_r"))
            .select("doc_id", "_r.*"))


def redacted(text: str, spans: Iterable[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first."""
    parts, at = [], 0
    end = -1
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= end:
            parts += [text[at:start], f"[{kind}]"]
        end = max(end, stop)
        at = end
    return "".join(parts) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
                   near: int = NEAR, around: int = AROUND) -> DataFrame:
    """``docs`` with every span in its texts replaced by ``[kind]``; rows and columns stay.

    Texts without a span, null ones among them, are not touched, repeated rows are treated each. ``length_col`` is set to the new
    number of characters of a changed text, if the table has that column.
    """
    def make():
        novelty = Novelty(near=near, around=around)

        def one(text):
            spans = find_spans(text, novelty)[1] if text else []
            return (redacted(text, spans) if spans else None,)
        return one

    changed = docs.select(row_of(docs).alias("row"),
                          row_udf("text string", make)(docs[text_col])["text"].alias("new"))
    columns = {c: F.col("row")[c] for c in docs.columns}
    columns[text_col] = F.coalesce("new", columns[text_col])
    if length_col in columns:
        columns[length_col] = F.coalesce(F.length("new"), columns[length_col]).cast(
            docs.schema[length_col].dataType)
    return changed.select(*[column.alias(c) for c, column in columns.items()])
