"""Column expressions on labels, surrogate values and texts. They run inside the JVM, but for those that work through a document's spans: these take Arrow batches."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow_column

#: Categories in order of precedence: the first whose keywords occur in the upper-case label wins, names are the rest.
_BASE = [
    ("email", "CORREO MAIL"),
    ("ip", "IP"),
    ("username", "USER"),
    ("phone", "TEL PHONE"),
    ("age", "AGE EDAD"),
    ("sex", "GENDER SEX SEXO"),
    ("date", "DATE DOB FECHA TIME"),
    ("idnum", "CARD DRIVER IDCARD ID_ LICEN NUMBER PASSPORT SOCIAL SSN TAX"),
    ("loc", "ADDR CALLE CITY COUNTRY GEO HOSP LOC PAIS STATE STREET TERRITORIO ZIP"),
]
#: Three conventions for the same cascade: where BOD and BIRTH belong, and whether sexes are told apart.
VARIANTS = {
    "v1": [(c, w + (" BIRTH BOD" if c == "date" else "")) for c, w in _BASE],
    "v2": [(c, w + (" BOD" if c == "age" else "")) for c, w in _BASE],
    "v3": [(c, w + (" BOD" if c == "age" else "")) for c, w in _BASE if c != "sex"],
}


def category(label: Column, variant: str = "v2") -> Column:
    """The category of a label; null counts as an unknown label, which is a name."""
    upper = F.upper(F.coalesce(label, F.lit("")))
    out = None
    for name, keywords in VARIANTS[variant]:
        hit = upper.rlike("|".join(keywords.split()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("name")


def category_sql(label: str, variant: str = "v2") -> str:
    cases = " ".join(f"WHEN regexp_matches(upper(coalesce({label}, '')), '{'|'.join(k.split())}') THEN '{c}'" for c, k in VARIANTS[variant])
    return f"CASE {cases} ELSE 'name' END"


@lru_cache(1000)
def category_of(label: str | None, variant: str = "v2") -> str:
    """``category`` of one label."""
    upper = (label or "").upper()
    return next((name for name, keywords in VARIANTS[variant] if any(k in upper for k in keywords.split())), "name")


#: Names and places by language; other languages use the English ones.
NAMES = {
    "en": ("Alma Reed", "Owen Hart", "Nora Finch", "Miles Grant", "Tess Doyle"),
    "fr": ("Lucie Morel", "Hugo Blanc", "Anouk Girard", "Noël Petit"),
    "de": ("Greta Vogt", "Jonas Kühn", "Lena Brandt", "Emil Roth"),
    "es": ("Inés Vidal", "Pablo Soler", "Marta Gil", "Iván Cano"),
    "nl": ("Sanne Bakker", "Daan Visser", "Fleur Smit"),
}
PLACES = {
    "en": ("Ashford", "Millbrook", "Harwick"),
    "fr": ("Valcourt", "Montreuil", "Brissac"),
    "de": ("Neustadt", "Altdorf", "Rosenheim"),
    "es": ("Villanueva", "Montilla", "Arroyo"),
    "nl": ("Houten", "Zeist", "Veere"),
}


def stable_number(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 from the text forms of its parts, equal in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def stable_numbers(seed: int):
    """A column function of an array and a document: for each element the ``stable_number`` of seed, document and its ordinal."""

    @arrow_column("array<bigint>")
    def run(items: pa.Array, doc_id: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(items), 0)).astype(np.int64)
        out = []
        for n, d in zip(sizes.tolist(), pc.cast(doc_id, pa.string()).to_pylist()):
            head = f"{seed}|" if d is None else f"{seed}|{d}|"
            out += [int(md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in range(n)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(out, pa.int64()))

    return run


def stable_number_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _pick(table: dict[str, tuple[str, ...]], language: Column, h: Column) -> Column:
    out = None
    for code, values in table.items():
        if code != "en":
            value = F.element_at(F.array(*map(F.lit, values)), (h % len(values) + 1).cast("int"))
            out = F.when(language == code, value) if out is None else out.when(language == code, value)
    values = table["en"]
    return out.otherwise(F.element_at(F.array(*map(F.lit, values)), (h % len(values) + 1).cast("int")))


def _pick_sql(table: dict[str, tuple[str, ...]], language: str, h: str) -> str:
    lists = {k: "[" + ", ".join(f"'{x}'" for x in v) + f"][1 + {h} % {len(v)}]" for k, v in table.items()}
    return f"CASE {language} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lists.items() if k != "en") + f" ELSE {lists['en']} END"


def fake_value(kind: Column, language: Column, h: Column) -> Column:
    """A surrogate of a category, of its usual shape, chosen by the stable number ``h``."""
    digits = lambda shift, width: F.lpad((F.floor(h / shift) % 10**width).cast("string"), width, "0")
    octet = lambda shift: (F.floor(h / shift) % 256).cast("bigint").cast("string")
    return (
        F.when(kind == "email", F.concat(F.lit("user"), digits(1, 4), F.lit("@mail"), digits(10000, 1), F.lit(".example.org")))
        .when(kind == "ip", F.concat_ws(".", F.lit("10"), octet(1), octet(256), octet(65536)))
        .when(kind == "username", F.concat(F.lit("user_"), digits(1, 5)))
        .when(kind == "phone", F.concat(F.lit("+1 (555) "), digits(1, 3), F.lit("-"), digits(1000, 4)))
        .when(kind == "age", (h % 98 + 1).cast("string"))
        .when(kind == "sex", F.when(h % 2 == 0, "male").otherwise("female"))
        .when(kind == "date", F.concat_ws("/", F.lpad((h % 28 + 1).cast("string"), 2, "0"), F.lpad((F.floor(h / 28) % 12 + 1).cast("bigint").cast("string"), 2, "0"), (F.floor(h / 336) % 90 + 1930).cast("bigint").cast("string")))
        .when(kind == "idnum", digits(1, 8))
        .when(kind == "loc", _pick(PLACES, language, h))
        .otherwise(_pick(NAMES, language, h))
    )


def fake_text(kind: str, language: str | None, h: int) -> str:
    """``fake_value`` of one number, for use in batches."""
    if kind == "name" or kind == "loc":
        table = NAMES if kind == "name" else PLACES
        values = table.get(language or "en", table["en"])
        return values[h % len(values)]
    if kind == "email":
        return f"user{h % 10000:04d}@mail{h // 10000 % 10}.example.org"
    if kind == "ip":
        return f"10.{h % 256}.{h // 256 % 256}.{h // 65536 % 256}"
    if kind == "phone":
        return f"+1 (555) {h % 1000:03d}-{h // 1000 % 10000:04d}"
    if kind == "date":
        return f"{h % 28 + 1:02d}/{h // 28 % 12 + 1:02d}/{h // 336 % 90 + 1930}"
    if kind == "username":
        return f"user_{h % 100000:05d}"
    if kind == "age":
        return str(h % 98 + 1)
    if kind == "sex":
        return "male" if h % 2 == 0 else "female"
    return f"{h % 10**8:08d}"


def fake_value_sql(kind: str, language: str, h: str) -> str:
    digits = lambda shift, width: f"lpad(CAST(({h} // {shift}) % {10**width} AS VARCHAR), {width}, '0')"
    octet = lambda shift: f"CAST(({h} // {shift}) % 256 AS VARCHAR)"
    return f"""CASE {kind}
      WHEN 'email' THEN 'user' || {digits(1, 4)} || '@mail' || {digits(10000, 1)} || '.example.org'
      WHEN 'ip' THEN '10.' || {octet(1)} || '.' || {octet(256)} || '.' || {octet(65536)}
      WHEN 'username' THEN 'user_' || {digits(1, 5)}
      WHEN 'phone' THEN '+1 (555) ' || {digits(1, 3)} || '-' || {digits(1000, 4)}
      WHEN 'age' THEN CAST({h} % 98 + 1 AS VARCHAR)
      WHEN 'sex' THEN CASE WHEN {h} % 2 = 0 THEN 'male' ELSE 'female' END
      WHEN 'date' THEN lpad(CAST({h} % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(({h} // 28) % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(({h} // 336) % 90 + 1930 AS VARCHAR)
      WHEN 'idnum' THEN {digits(1, 8)}
      WHEN 'loc' THEN {_pick_sql(PLACES, language, h)}
      ELSE {_pick_sql(NAMES, language, h)} END"""


_SHAPES = {"email": r"[^\s@]+@[^\s@]+[.][^\s@]+", "ip": r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "digit": r"[0-9]", "any": r"[\p{L}\p{N}]"}


def well_formed(kind: Column, value: Column) -> Column:
    """Whether a value has the shape of its category; blank and null ones don't."""
    shape = F.when(kind == "email", value.rlike(_SHAPES["email"])).when(kind == "ip", value.rlike(_SHAPES["ip"])).when(kind.isin("phone", "date", "age"), value.rlike(_SHAPES["digit"])).otherwise(value.rlike(_SHAPES["any"]))
    return F.coalesce((F.trim(value) != "") & shape, F.lit(False))


def well_formed_sql(kind: str, value: str) -> str:
    shape = " ".join(f"WHEN {kind} {test} THEN regexp_matches({value}, '{_SHAPES[k]}')" for k, test in (("email", "= 'email'"), ("ip", "= 'ip'"), ("digit", "IN ('phone', 'date', 'age')")))
    return f"coalesce(trim({value}) <> '' AND CASE {shape} ELSE regexp_matches({value}, '{_SHAPES['any']}') END, false)"


def verdict(label: Column, original: Column, surrogate: Column) -> Column:
    """Struct failure, valid, type_consistent of a surrogate: a leaked run of x, a broken shape, or none."""
    leaked = F.coalesce(surrogate.rlike("(?i)x{4,}") & ~F.coalesce(original, F.lit("")).rlike("(?i)x{4,}"), F.lit(False))
    says = lambda a, b, c: F.struct(F.lit(a).alias("failure"), F.lit(b).alias("valid"), F.lit(c).alias("type_consistent"))
    return F.when(leaked, says("x_masked", "N", "Y")).when(~well_formed(category(label, "v3"), surrogate), says("truncated_garbled", "N", "N")).otherwise(says("none", "Y", "Y"))


def context_window(text: Column, start: Column, end: Column, around: int = 40) -> Column:
    """The span between brackets, with ``around`` characters on both sides on one line."""
    left = F.greatest(start - around, F.lit(0))
    cut = lambda a, n: text.substr(a.cast("int"), n.cast("int"))
    return F.translate(F.concat(cut(left + 1, start - left), F.lit("⟦"), cut(start + 1, end - start), F.lit("⟧"), cut(end + 1, F.lit(around))), "\n", " ")


def contexts(around: int = 40):
    """A column function of text and spans to the ``context_window`` of each span. (In the JVM every span would walk the text from its start, in a row with a copy of it.)"""

    @arrow_column("array<string>")
    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(spans), 0)).astype(np.int64)
        flat = spans.flatten()
        starts, ends = np.asarray(flat.field("start")).tolist(), np.asarray(flat.field("end")).tolist()
        out, at = [], 0
        for t, n in zip(text.to_pylist(), sizes.tolist()):
            for a, b in zip(starts[at : at + n], ends[at : at + n]):
                out.append(None if t is None else f"{t[max(a - around, 0) : a]}⟦{t[a:b]}⟧{t[b : b + around]}".replace("\n", " "))
            at += n
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(out, pa.string()))

    return run


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def run_name(stem: Column) -> Column:
    """A run's benchmark name: its file stem without a timestamp."""
    return F.regexp_replace(stem, r"_[0-9]{10,}$", "")


def run_time(stem: Column) -> Column:
    """The UTC time in a stem's timestamp, '' without one."""
    digits = F.regexp_extract(stem, r"([0-9]{10,})$", 1)
    seconds = F.when(digits != "", digits.cast("bigint"))
    return F.coalesce(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd HH:mm 'UTC'"), F.lit(""))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.1f", value * 100))


def delta(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%+.3f", value))
