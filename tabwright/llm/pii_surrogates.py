"""Surrogates for personal data: keyed, of the same kind and shape, distinct, and the same everywhere.

Texts that may hold an entity are read for mentions; distinct entities get surrogates drawn with a
keyed hash. A surrogate that two entities draw, that an entity already has, or that is itself an
entity of the corpus, is drawn again by all but one, round by round; after WIDEN rounds the space of
every kind grows with each round, so the rounds end however few surrogates of an entity's own shape
there are. Domains of e-mail addresses are entities of their own. A name is one entity whatever
gender its mentions show: the only gender they show, else none. The chosen surrogates go back to the
mentions, which keep their own spacing, punctuation and case.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.store import keep
from tabwright.llm.texts import portions

DEFAULT_KEY = "change-me"
WIDEN = 6  # rounds in an entity's own shape

# Given names by gender and script, and surnames: the pools surrogates are drawn from.
GIVEN = {
    ("m", "LATIN"): "James Robert Michael William David Thomas Daniel Matthew Anthony Steven Kenneth Kevin Brian George Edward Ronald Jeffrey Gregory Patrick Dennis Walter Peter Harold Douglas Henry Carl Arthur Klaus Stefan Juergen Pierre Philippe Carlos Fernando Alejandro".split(),
    ("f", "LATIN"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Monika Sabine Brigitte Isabelle Veronique Carmen Lucia Valentina".split(),
    ("n", "LATIN"): "Alex Jordan Taylor Morgan Casey Riley Jamie Avery Quinn Rowan Sasha Robin Kerry Leslie Dana Jesse".split(),
    ("m", "CYRILLIC"): "Александр Дмитрий Сергей Андрей Алексей Михаил Николай Виктор Павел Олег".split(),
    ("f", "CYRILLIC"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("n", "CYRILLIC"): "Саша Женя Валя".split(),
}
SURNAMES = {
    ("n", "LATIN"): "Anderson Baker Bennett Brooks Carter Collins Cooper Coleman Dawson Edwards Fisher Foster Gardner Graham Griffin Hamilton Harrison Henderson Hughes Jenkins Keller Lambert Lawson Marshall Mitchell Murray Nelson Palmer Parker Peterson Reynolds Richards Sanders Simmons Spencer Stewart Sullivan Turner Wagner Wallace Watson Weber Winkler Zimmermann Moreau Laurent Girard Navarro Romero Delgado".split(),
    ("m", "CYRILLIC"): "Иванов Смирнов Кузнецов Попов Соколов Лебедев Новиков Морозов Волков Зайцев".split(),
    ("f", "CYRILLIC"): "Иванова Смирнова Кузнецова Попова Соколова Лебедева Новикова Морозова Волкова Зайцева".split(),
}
# Given names known without a title, besides those of the pools.
OTHER_GIVEN = {
    "m": "John Paul Charles Joseph Christopher Mark Donald Andrew Joshua Timothy Jason Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Raymond Frank Alexander Jack Jerry Tyler Aaron Jose Adam Nathan Zachary Kyle Noah Ethan Jeremy Christian Keith Roger Terry Austin Sean Gerald Dylan Bryan Bruce Lawrence Gabriel Joe Logan Alan Juan Wayne Roy Ralph Randy Eugene Vincent Russell Louis Philip Bobby Johnny Bradley Ian Simon Martin Neil Graham Stuart Colin Nigel Trevor Oliver Liam Lucas Mason Elijah Owen Isaac Luke Connor Evan Adrian Julian Leo Max Felix Oscar Hugo Victor Edgar Alfred Ernest Fred Howard Leonard Norman Stanley Theodore Tom Tim Jim Bob Mike Dave Steve Dan Matt Tony Ken Greg Jeff Hans Peter Wolfgang Juergen Jürgen Dieter Manfred Uwe Heinz Helmut Werner Gerhard Horst Günter Andreas Michael Thomas Markus Matthias Sebastian Tobias Florian Lukas Jonas Jan Jens Kai Lars Sven Rainer Bernd Ralf Jörg Karl Otto Fritz Ludwig Johannes Jean Jacques Michel Alain Bernard François Christophe Nicolas Laurent Olivier Julien Antoine Guillaume Henri Marcel René Luc Thierry Pascal Yves Luis Antonio Manuel Francisco Miguel Pedro Pablo Javier Jorge Diego Rafael Sergio Alberto Ricardo Andrés Mario Marco Giovanni Giuseppe Luigi Paolo Andrea Matteo Luca Stefano Francesco Roberto Ahmed Mohamed Mohammed Muhammad Ali Omar Hassan Ibrahim Raj Rahul Amit Sanjay Arjun Vijay Wei Hiroshi Kenji Takashi Ivan Dmitri Sergei Vladimir Igor Boris Piotr Tomasz Krzysztof Marek Erik Anders Nils Olaf Henrik".split(),
    "f": "Maria Anna Ann Anne Betty Dorothy Lisa Donna Ruth Helen Angela Sophia Emma Olivia Ava Isabella Mia Charlotte Amelia Harper Evelyn Abigail Ella Chloe Samantha Anita Julie Joyce Victoria Kelly Christina Christine Joan Lauren Judith Olga Martha Cheryl Megan Andrea Hannah Jacqueline Gloria Teresa Theresa Sara Janice Marie Julia Kathryn Katherine Catherine Frances Jean Alice Judy Beverly Denise Marilyn Amber Danielle Brittany Diana Natalie Jane Sophie Lucy Emily Zoe Claire Fiona Gemma Hazel Irene Josephine Kate Katie Anna Lily Louise Marion Nora Pamela Paula Rachel Rosa Ellen Elena Eva Eleanor Edith Esther Florence Gertrude Heidi Ingrid Ursula Renate Petra Claudia Susanne Andrea Birgit Gabriele Martina Heike Angelika Silke Katrin Kathrin Anja Tanja Nicole Melanie Sandra Julia Lena Lea Johanna Katharina Greta Hilde Helga Ilse Erika Gisela Karin Marlene Nathalie Sylvie Françoise Catherine Martine Chantal Céline Camille Hélène Élise Amélie Aurélie Juliette Manon Margaux Simone Yvonne Ana Isabel Pilar Dolores Teresa Cristina Marta Paula Raquel Rocío Sofia Sofía Gabriela Daniela Alejandra Adriana Mariana Guadalupe Juana Giulia Chiara Francesca Federica Elisa Paola Silvia Fatima Aisha Layla Leila Yasmin Zainab Priya Anjali Deepa Lakshmi Sunita Mei Yuki Sakura Keiko Natasha Svetlana Tatiana Irina Ekaterina Agnieszka Katarzyna Magdalena Astrid Freya Kirsten Sigrid".split(),
    "n": "Chris Pat Sam Kim Lee Jo Lou Charlie Frankie Drew Blake Cameron Dakota Devon Jackie Jody Kai Kendall Reese Skyler Toni".split(),
    "m ": "Иван Владимир Борис Игорь Юрий Анатолий Константин Евгений Максим Денис Антон Роман Артём Илья Кирилл Василий Григорий Пётр Фёдор Вадим Станислав Виталий Леонид Семён Георгий Тимофей Никита Егор".split(),
    "f ": "Надежда Вера Любовь Людмила Галина Валентина Нина Тамара Лариса Оксана Алина Дарья Виктория Ксения Полина Александра Софья Вероника Маргарита Евгения Алла Инна Лидия Раиса Зоя Анастасия Алиса Кристина".split(),
}
TITLES = {
    "m": "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа",
    "n": "Mx|Dr|Prof|Professor|Доктор",
}
SECRET_WORDS = "api[_ -]?key|access[_ -]?key|secret|token|password|passwd|bearer"

NAME = r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*"
PATTERNS: tuple[tuple[str, re.Pattern], ...] = (
    ("secret", re.compile(rf"(?i)(?<![\w])(?:{SECRET_WORDS})[\"']?\s*(?:[:=]|\sis\s)\s*[\"']?(?P<x>[\w+/=.\-]{{16,}})")),
    ("email", re.compile(r"(?<![\w.+%-])(?P<x>\w[\w.+%-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")),
    ("iban", re.compile(r"(?<![\w])(?P<x>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w])")),
    ("ip6", re.compile(r"(?<![\w:])(?P<x>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)")),
    ("ip4", re.compile(r"(?<![\d.])(?P<x>\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)")),
    ("card", re.compile(r"(?<![\d.])(?P<x>\d(?:[ -]?\d){12,18})(?![\d])")),
    ("ssn", re.compile(r"(?<![\d-])(?P<x>(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?P<x>\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){1,4})(?!\d)")),
    ("phone", re.compile(r"(?<![\w+./-])(?P<x>(?:1[ ./-]?(?:\(\d{3}\)[ ./-]?|\d{3}[ ./-])|\([2-9]\d{2}\)[ ./-]?|[2-9]\d{2}[ ./-])\d{3}[ ./-]\d{4})(?!\d|[./-]\d)")),
    ("phone", re.compile(r"(?<![\w+./-])(?P<x>0\d{2,5}[ /-]\d{5,8}|0\d{2,4}(?:[ ./-]\d{2,4}){2,4}|0\d(?:[ ./-]\d{2}){4}|\(0\d{1,5}\) ?\d{3,8}(?:[ -]\d{2,5}){0,2})(?!\d|[.:/-]\d)")),
    ("phone", re.compile(r"(?<![\w+.-])(?P<x>(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4})(?![\d-])")),
)
TITLED = re.compile("|".join(rf"(?P<{g}>\b(?:{words})\b\.?)" for g, words in TITLES.items()))
AFTER_TITLE = re.compile(rf"\s(?P<a>{NAME})(?:\s(?P<b>{NAME}))?")
PAIR = re.compile(rf"(?<![\w])(?P<a>{NAME})\s(?P<b>{NAME})")
# Java form of what any text with a mention must hold besides the words of a secret: a digit (phones
# and IP addresses have one), an at sign, a title before a capital, or two capitalised words.
MAYBE = (
    r"[\p{Nd}@]|(?=[DFHMPSГД])(?:" + "|".join(TITLES.values()) + r")\.?[\s\h]\p{Lu}|\p{Lu}\p{Ll}+[\s\h]\p{Lu}"
)
MAYBE_SECRET = ("key", "secret", "token", "passw", "bearer")
KNOWN = {name: gender.strip() for gender, names in OTHER_GIVEN.items() for name in names}
KNOWN |= {name: gender for (gender, _), names in GIVEN.items() for name in names}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 - (len(digits) - i) % 2) for i, d in enumerate(digits)]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _is_card(digits: str) -> bool:
    issuer = re.match(
        r"4(?:\d{12}|\d{15}|\d{18})$|5[1-5]\d{14}$|2[2-7]\d{14}$|3[47]\d{13}$|6(?:011|5\d\d)\d{12}$|35\d{14}$|3[068]\d{12}$",
        digits,
    )
    return bool(issuer) and luhn(digits)


def _iban_check(body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body)) % 97


def _valid(kind: str, value: str) -> bool:
    if kind == "ip4":
        return all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in value.split("."))
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return any(c.isdigit() for c in value)
    if kind == "card":
        return _is_card(re.sub(r"\D", "", value))
    if kind == "iban":
        plain = value.replace(" ", "")
        return _iban_check(plain[4:] + plain[:4]) == 1
    if kind == "phone":
        return 8 <= sum(c.isdigit() for c in value) <= 15
    if kind == "secret":
        return any(c.isdigit() for c in value) or not value.islower()
    return True


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity: digits alone, or letters without case."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", value)
    return value.replace(" ", "").upper() if kind == "iban" else value.lower()


def _script(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split(" ")[0]


def _surname(gender: str, word: str) -> str:
    """Surnames show a gender only in scripts whose pool does, so one name stays one entity elsewhere."""
    script = _script(word)
    return f"surname-{gender if (gender, script) in SURNAMES else 'n'}-{script}"


def _named(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of given names and surnames with the gender they show, as kinds."""
    for met in TITLED.finditer(text):
        gender = met.lastgroup
        parts = AFTER_TITLE.match(text, met.end())
        if not parts or not parts["a"][0].isupper() or len(parts["a"]) < 2:
            continue
        if parts["b"] and parts["b"][0].isupper() and len(parts["b"]) > 1:
            yield *parts.span("a"), f"given-{gender}-{_script(parts['a'])}"
            yield *parts.span("b"), _surname(gender, parts["b"])
        else:
            yield *parts.span("a"), _surname(gender, parts["a"])
    at = 0
    while met := PAIR.search(text, at):
        at = met.start("b")
        gender = KNOWN.get(met["a"])
        if gender and met["b"][0].isupper() and len(met["b"]) > 1 and not met["b"].isupper():
            yield *met.span("a"), f"given-{gender}-{_script(met['a'])}"
            yield *met.span("b"), _surname(gender, met["b"])


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every entity, left to right, none overlapping; earlier patterns win."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    spans = [(*m.span("x"), kind) for kind, pattern in PATTERNS for m in pattern.finditer(text) if _valid(kind, m["x"])]
    for start, end, kind in [*spans, *_named(text)]:
        if all(end <= a or b <= start for a, b in taken):
            taken.append((start, end))
            found.append((start, end, kind))
    return [(a, b, kind, normal(kind, text[a:b])) for a, b, kind in sorted(found)]


class Draws:
    """An endless keyed stream of small numbers for one entity and attempt."""

    def __init__(self, key: str, *parts: object):
        self.seed = hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()
        self.block, self.pool = 0, b""

    def below(self, limit: int) -> int:
        if len(self.pool) < 8:
            self.pool = hashlib.sha256(self.seed + self.block.to_bytes(8, "big")).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % limit

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def pick(self, options):
        return options[self.below(len(options))]


@lru_cache(maxsize=4_096)
def _letters_like(char: str) -> str:
    """Lower-case letters of the same script within the character's block of 64 code points."""
    script, low = _script(char), ord(char) // 64 * 64
    like = [c for c in map(chr, range(low, low + 64)) if c.isalpha() and c.lower() == c and _script(c) == script]
    return "".join(like) or char


def _like(draws: Draws, value: str, hexadecimal: bool = False) -> str:
    """Every letter and digit drawn anew, the rest kept."""
    if hexadecimal:
        return "".join(draws.pick("0123456789abcdef") if c.isalnum() else c for c in value)
    ascii_letters = "abcdefghijklmnopqrstuvwxyz"
    return "".join(
        str(draws.below(10)) if c.isdigit() else draws.pick(ascii_letters if c.isascii() else _letters_like(c)) if c.isalpha() else c
        for c in value
    )


def _pooled(draws: Draws, kind: str, value: str, attempt: int, more: str) -> str:
    """A name of the same gender and script; more parts, then free letters, as attempts go on."""
    part, gender, script = kind.split("-", 2)
    pools = GIVEN if part == "given" else SURNAMES
    pool = pools.get((gender, script)) or pools.get(("n", script))
    if pool is None or more:
        return _like(draws, value.lower() + more)
    return "-".join(draws.pick(pool) for _ in range(1 if attempt < 2 else 2 if attempt < 5 else 3)).lower()


def surrogate(key: str, kind: str, value: str, attempt: int, domain: str | None = None) -> str:
    """The normal form drawn for an entity at the given attempt; valid wherever the kind has a check digit.

    `domain` is the one that takes the place of an e-mail address's own. From attempt WIDEN on less of
    the value is kept and more is added: letters to words, digits to phones and social security
    numbers, any first number to IPv4 addresses and then all of IPv6.
    """
    draws = Draws(key, kind, value, attempt)
    wide = max(0, attempt - WIDEN + 1)
    more = "a" * wide
    if kind == "email":
        return f"{_like(draws, value.rsplit('@', 1)[0] + more)}@{domain}"
    if kind == "domain":
        name, top = value.rsplit(".", 1)
        return f"{_like(draws, name + more)}.{top}"
    if kind == "ip6" and wide or kind == "ip4" and wide > WIDEN:  # short forms have few others of their shape
        return ":".join(f"{draws.below(65_536):x}" for _ in range(8))
    if kind == "ip4":
        first = int(value.split(".")[0])
        lead = first if first in (10, 127) and not wide else draws.pick([n for n in range(11, 224) if n != 127])
        return ".".join(map(str, [lead, draws.below(256), draws.below(256), 1 + draws.below(254)]))
    if kind in ("ip6", "secret"):
        return _like(draws, value + more, hexadecimal=kind == "ip6" or bool(re.fullmatch(r"[0-9a-f-]+", value)))
    if kind == "card":
        body = value[:1] + draws.digits(len(value) - 2) if value[0] == "4" or wide else value[:4] + draws.digits(len(value) - 5)
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "ssn":
        return f"{100 + draws.below(500):03d}{1 + draws.below(99):02d}{1 + draws.below(9999):04d}{draws.digits(wide)}"
    if kind == "phone":
        kept = 0 if wide else 1 if value[0] in "17" else 2
        return value[:kept] + draws.digits(len(value) - kept + wide)
    if kind == "iban":
        body = "".join(str(draws.below(10)) if c.isdigit() else draws.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in value[4:])
        return f"{value[:2]}{98 - _iban_check(body + value[:2] + '00'):02d}{body}"
    return _pooled(draws, kind, value, attempt, more)


def dressed(kind: str, mention: str, drawn: str) -> str:
    """The drawn normal form with the spacing, punctuation and case of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(drawn)
        return "".join(next(rest) if c.isalnum() else c for c in mention) + "".join(rest)
    if mention.isupper():
        return drawn.upper()
    if kind.startswith(("given", "surname")):
        return "-".join(p.capitalize() for p in drawn.split("-"))
    if len(drawn) == len(mention):
        return "".join(d.upper() if m.isupper() else d for d, m in zip(drawn, mention, strict=True))
    return drawn


def _detect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "start", "stop", "kind", "value"]
    for part in portions(batches):
        rows = []
        for k1, k2, text in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
            rows += [(k1, k2, *met) for met in mentions(text)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in portions(batches):
        texts, counts = [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            pieces, at = [], 0
            for span in spans or []:
                mention = text[span["start"] : span["stop"]]
                pieces += [text[at : span["start"]], dressed(span["kind"], mention, span["drawn"])]
                at = span["stop"]
            texts.append("".join([*pieces, text[at:]]))
            counts.append(len(spans or []))
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
            names=["row", "text", "replaced"],
        )


def _drawing(key: str) -> Callable:
    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series, domain: pd.Series) -> pd.Series:
        rows = zip(kind, value, attempt.tolist(), domain, strict=True)
        return pd.Series([surrogate(key, *x) for x in rows], dtype=object)

    return draw


def _settled(pending: DataFrame, key: str) -> DataFrame:
    """(space, value, drawn) for distinct (space, value) with a kind and a domain: rounds until all have one."""
    draw = _drawing(key)
    real = pending.select("space", F.col("value").alias("drawn"))
    settled: DataFrame | None = None
    attempt = 0
    while pending.limit(1).count():
        drawn = pending.withColumn("drawn", draw("kind", "value", F.lit(attempt), "domain"))
        free = drawn.join(real, ["space", "drawn"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("space", "drawn"), ["space", "drawn"], "left_anti")
        won = keep(free.groupBy("space", "drawn").agg(F.min("value").alias("value")))
        settled = won if settled is None else settled.unionByName(won)
        pending = keep(pending.join(won.select("space", "value"), ["space", "value"], "left_anti"))
        attempt += 1
    if settled is None:
        return pending.select("space", "value", F.lit("").alias("drawn"))
    return settled.select("space", "value", "drawn")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, drawn) for distinct (kind, value): no two values share one, and none is itself in the corpus.

    Names of one part and script share a space, whatever gender they were read with, and a value has
    one surrogate in it: of the gender its kinds show, of none if they show two or none. Addresses of
    one domain keep sharing one, of two domains never.
    """
    space = F.regexp_replace("kind", "-[mfn]-", "-")
    met = keep(entities.select("kind", "value", space.alias("space")).distinct())
    shown = [F.max(F.col("kind").contains(f"-{g}-")) for g in "mf"]
    gender = F.when(shown[0] & ~shown[1], "-m-").when(shown[1] & ~shown[0], "-f-").otherwise("-n-")
    values = met.groupBy("space", "value").agg(F.regexp_replace(F.min("kind"), F.lit("-[mfn]-"), gender).alias("kind"))
    domain = F.when(F.col("space") == "email", F.substring_index("value", "@", -1))
    values = keep(values.withColumn("own", domain))
    domains = values.where("own is not null").select(F.col("own").alias("value")).distinct()
    named = keep(domains.select("value", *[F.lit("domain").alias(c) for c in ("kind", "space")], F.lit(None).cast("string").alias("domain")))
    other = _settled(named, key).select(F.col("value").alias("own"), F.col("drawn").alias("domain"))
    # a domain can hold a third of all addresses: those of other kinds stay out of the join, which AQE may split
    mailed = values.where("own is not null").join(other, "own").select("kind", "value", "space", "domain")
    rest = values.where("own is null").select("kind", "value", "space", F.lit(None).cast("string").alias("domain"))
    return met.join(_settled(keep(mailed.unionByName(rest)), key), ["space", "value"]).select("kind", "value", "drawn")


def pseudonymize(
    docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None
) -> DataFrame:
    """`docs`, same rows and columns, with surrogates in `text_col`; `count_col` adds how many per row.

    `key` is secret; another key gives other surrogates, the same key the same ones for the same
    corpus. Null and empty texts and texts without entities stay as they are. Repeated rows, also
    under one id, are read each and come out alike. All other columns pass through whatever their
    names. An empty table gives an empty table.
    """
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    low = F.lower(F.col("text"))
    maybe = F.col("text").rlike(MAYBE)
    for word in MAYBE_SECRET:
        maybe = maybe | low.contains(word)
    marked = packed.withColumn("maybe", F.coalesce(maybe, F.lit(False)))
    id_hash = F.xxhash64(F.col("row")[id_col])
    read = marked.where("maybe").select(
        "row", "text", id_hash.alias("k1"), F.xxhash64("text").alias("k2")
    )
    met = keep(
        read.select("k1", "k2", "text").mapInArrow(
            _detect, "k1 long, k2 long, start long, stop long, kind string, value string"
        )
    )
    chosen = keep(surrogates(met.select("kind", "value"), key))
    spans = keep(
        met.distinct()
        .join(chosen, ["kind", "value"])
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "drawn"))).alias("spans"))
    )
    kind = packed.schema["row"].dataType.simpleString()
    # Spans grow with the documents: the same join by shuffle at every size.
    changed = (
        read.join(spans.hint("merge"), ["k1", "k2"], "left")
        .select("row", "text", "spans")
        .mapInArrow(_replace, f"row {kind}, text string, replaced long")
    )
    same = marked.where("not maybe").select("row", "text", F.lit(0).cast("long").alias("replaced"))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if count_col is not None:
        columns.append(F.col("replaced").alias(count_col))
    return same.unionByName(changed).select(*columns)
