"""Label normalisation: names of units, categories, nationalities, permits, periods."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import let

# Category patterns over normalised labels; the first that matches names the label.
RELIGION_PATTERNS = [
    ("konghucu", r"k?h?ong\s*hu\s*ch?u|k?h?ong\s*hu\s*tju|kong\s*fu\s*(cu|tse)|confuc|konfusian|\bkhong\b"),
    ("kepercayaan", r"kepercayaan|penghayat|aliran"),
    ("islam", r"\bislam\b|muslim"),
    ("kristen", r"kristen|protestan"),
    ("katolik", r"katolik|katholik|catholic"),
    ("hindu", r"\bhindu\b"),
    ("buddha", r"bud+h?a|buddhis"),
    ("lainnya", r"lain|other"),
    ("total", r"jumlah|total"),
]
#: What a label needs to name a religion or a total, whatever its case: letters of each pattern, or others than ASCII, which can stand for them.
RELIGION_HINT = r"(?i)ong|conf|konf|percaya|hayat|aliran|islam|muslim|kristen|protestan|atolik|atholi|hindu|bud|lain|other|jumlah|total|[^\x00-\x7f]"
#: What the commonest headers, spelled just so, name: read without normalising.
RELIGION_NAMES = {
    "Islam": "islam", "Kristen": "kristen", "Protestan": "kristen", "Katolik": "katolik", "Katholik": "katolik", "Hindu": "hindu", "Buddha": "buddha", "Budha": "buddha",
    "Konghucu": "konghucu", "Khonghucu": "konghucu", "Lainnya": "lainnya", "Jumlah": "total", "Total": "total",
}
RELIGIONS = ["islam", "kristen", "katolik", "hindu", "buddha", "konghucu", "kepercayaan", "lainnya"]
MAJOR_RELIGIONS = ["islam", "kristen", "katolik"]

# Nationality patterns over normalised labels, in order of precedence. The Korean
# pattern leaves the north to its own entry.
NATIONALITY_PATTERNS = [
    ("TWN", r"\btaiwan\b|republik china|china taipei"),
    ("HKG", r"hong\s*kong|hongkong"),
    ("CHN", r"tiongkok|\bchina\b|\bcina\b|\brrt\b|rep(ublik)? rakyat|\bprc\b|chinese|中国"),
    ("JPN", r"jepang|japan"),
    ("KOR", r"korea sel|korea selatan|south korea|\bkorea\b(?! utara)"),
    ("IND", r"\bindia\b"),
    ("MYS", r"malaysia"),
    ("SGP", r"singapura|singapore"),
    ("AUS", r"australia"),
    ("USA", r"amerika serikat|united states|\busa\b|\bas\b"),
    ("GBR", r"inggris|united kingdom|britain"),
    ("PHL", r"filipina|philippin"),
    ("THA", r"thailand"),
    ("VNM", r"vietnam"),
    ("DEU", r"jerman|german"),
    ("NLD", r"belanda|netherland"),
    ("FRA", r"pran?cis|france|french"),
    ("RUS", r"rusia|russia"),
    ("CAN", r"kanada|canada"),
    ("ITA", r"italia"),
    ("ESP", r"spanyol|spain"),
    ("PAK", r"pakistan"),
    ("BGD", r"bangladesh"),
    ("LKA", r"sri ?lanka"),
    ("TLS", r"timor"),
    ("PNG", r"papua nugini|papua new guinea"),
    ("SAU", r"arab saudi|saudi"),
    ("EGY", r"mesir|egypt"),
    ("NGA", r"nigeria"),
    ("ZAF", r"afrika selatan|south africa"),
    ("NZL", r"selandia baru|new zealand"),
    ("CHE", r"swiss|switzerland"),
    ("SWE", r"swedia|sweden"),
    ("BEL", r"belgia|belgium"),
    ("MMR", r"myanmar"),
    ("KHM", r"kamboja|cambodia"),
    ("LAO", r"\blaos?\b"),
    ("BRN", r"brunei"),
    ("TUR", r"turki|turkey"),
    ("IRN", r"\biran\b"),
    ("IRQ", r"\birak\b|\biraq\b"),
    ("YEM", r"yaman|yemen"),
    ("PRK", r"korea utara|north korea"),
    ("OTHER", r"lain|other|negara lainnya"),
    ("TOTAL", r"^jumlah|^total|^seluruh"),
]
# Residence permits, in order of precedence.
PERMIT_PATTERNS = [
    ("ITAS", r"\bitas\b|kitas|terbatas|limited stay"),
    ("ITAP", r"\bitap\b|kitap|\btetap\b|permanent"),
    ("ITK", r"\bitk\b|kunjungan|visit"),
    ("TKA", r"\btka\b|tenaga kerja asing|foreign worker|imta|rptka"),
    ("TOTAL", r"^jumlah|^total"),
]
# Spellings of unit names (normalised, without spaces) that stand for another.
UNIT_ALIASES = {
    "pali": "penukalabablematangilir",
    "labuanbatuutara": "labuhanbatuutara",
    "labuanbatuselatan": "labuhanbatuselatan",
    "labuanbatu": "labuhanbatu",
    "kepseribu": "kepulauanseribu",
    "kepulauantanimbar": "malukutenggarabarat",
    "pasir": "paser",
    "sidrap": "sidenrengrappang",
    "sinderengrappang": "sidenrengrappang",
    "kepulauansitaro": "siautagulandangbiaro",
    "sitaro": "siautagulandangbiaro",
    "mamujuutara": "pasangkayu",
    "pangkep": "pangkajenedankepulauan",
    "pangkajenekepulauan": "pangkajenedankepulauan",
    "tanjabbarat": "tanjungjabungbarat",
    "tobasamosir": "toba",
    "selayar": "kepulauanselayar",
    "padangsidempuan": "padangsidimpuan",
    "mahakamhulu": "mahakamulu",
    "tajounauna": "tojounauna",
    "tanjabtimur": "tanjungjabungtimur",
}


# Codes and names of provinces, and further spellings of names.
PROVINCES = {
    "11": "Aceh", "12": "Sumatera Utara", "13": "Sumatera Barat", "14": "Riau", "15": "Jambi", "16": "Sumatera Selatan", "17": "Bengkulu", "18": "Lampung",
    "19": "Kepulauan Bangka Belitung", "21": "Kepulauan Riau", "31": "DKI Jakarta", "32": "Jawa Barat", "33": "Jawa Tengah", "34": "DI Yogyakarta", "35": "Jawa Timur",
    "36": "Banten", "51": "Bali", "52": "Nusa Tenggara Barat", "53": "Nusa Tenggara Timur", "61": "Kalimantan Barat", "62": "Kalimantan Tengah",
    "63": "Kalimantan Selatan", "64": "Kalimantan Timur", "65": "Kalimantan Utara", "71": "Sulawesi Utara", "72": "Sulawesi Tengah", "73": "Sulawesi Selatan",
    "74": "Sulawesi Tenggara", "75": "Gorontalo", "76": "Sulawesi Barat", "81": "Maluku", "82": "Maluku Utara", "91": "Papua", "92": "Papua Barat",
    "93": "Papua Selatan", "94": "Papua Tengah", "95": "Papua Pegunungan", "96": "Papua Barat Daya",
}
PROVINCE_ALIASES = {"daerahkhususibukotajakarta": "31", "dkijakarta": "31", "jakarta": "31", "daerahistimewayogyakarta": "34", "yogyakarta": "34"}


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Blocks of characters that stand for others: Latin letters with marks, ligatures, full-width and half-width forms,
#: super- and subscripts, number forms, enclosed and squared letters, compatibility forms.
_BLOCKS = [(0xA0, 0x250), (0x1D2C, 0x1DC0), (0x1E00, 0x1F00), (0x2000, 0x2100), (0x2100, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0x3200, 0x3400), (0xFB00, 0xFB07), (0xFE30, 0xFE70), (0xFF00, 0xFFF0)]


@lru_cache(maxsize=1)
def _plain_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose full decomposition, less combining marks, is one other character, and those where it is several or none."""
    one, several = {}, {}
    for point in (p for low, high in _BLOCKS for p in range(low, high)):
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and unicodedata.category(c) != "Cn":
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


def strip_accents(text: str | Column) -> Column:
    """Text in compatibility form without combining marks: letters without their marks, ligatures and wide forms spelled out.

    Characters that one other stands for are translated; texts with one that stands for several are rewritten
    character by character.
    """
    one, several = _plain_forms()
    s, entry, pair = _col(text), "\x01", "\x02"
    names = F.str_to_map(F.lit(entry.join(f"{c}{pair}{plain}" for c, plain in several.items())), F.lit(entry), F.lit(pair))
    spelled = F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    long = F.when(s.rlike("[" + "".join(several) + "]"), spelled).otherwise(s)
    plain = F.regexp_replace(F.translate(long, "".join(one), "".join(one.values())), r"\p{M}", "")
    # plain ASCII, which most labels are, stays as it is
    return F.when(s.rlike(r"[^\x00-\x7f]"), plain).otherwise(s)


def norm_label(text: str | Column) -> Column:
    """Lower case without accents; runs of white space, '_', '-' and '.' are one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"(?U)[\s_\-.]+", " "))


def strip_tags(text: str | Column) -> Column:
    """Text without markup tags."""
    return F.regexp_replace(_col(text), r"<[^>]+>", "")


def first_match(label: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    """Name of the first pattern that the label matches, else null."""
    def chain(s: Column) -> Column:
        out = F
        for name, pattern in patterns:
            out = out.when(s.rlike(f"(?U){pattern}"), F.lit(name))
        return out

    return let(label, chain)


def known_religion(text: str | Column) -> Column:
    """What one of ``RELIGION_NAMES`` names, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in RELIGION_NAMES.items() for x in pair]), _col(text))


def canonical_religion(text: str | Column) -> Column:
    """Religion that a label names; ``total`` for totals. Labels without a pattern's letters, which most are, are not normalised."""
    return F.when(_col(text).rlike(RELIGION_HINT), F.coalesce(known_religion(text), first_match(norm_label(text), RELIGION_PATTERNS)))


def canonical_nationality(text: str | Column) -> Column:
    """Country code that a label names; OTHER and TOTAL come last."""
    return first_match(norm_label(text), NATIONALITY_PATTERNS)


def canonical_permit(text: str | Column) -> Column:
    """Residence permit that a label names."""
    return first_match(norm_label(text), PERMIT_PATTERNS)


def year_from_text(text: str | Column) -> Column:
    """The last year from 1980 to 2049 that stands alone in the text."""
    found = F.regexp_extract_all(_col(text).cast("string"), F.lit(r"(?U)\b(19[89]\d|20[0-4]\d)\b"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).cast("int")


def semester_from_text(text: str | Column) -> Column:
    """Half-year that a text names, in Arabic or Roman figures."""
    found = F.regexp_extract(norm_label(text), r"semester\s*(ii|i|1|2)\b", 1)
    return F.when(found.isin("i", "1"), 1).when(found.isin("ii", "2"), 2)


def header_role(text: str | Column) -> Column:
    """Role of a header or row label as struct(role, value).

    Totals first, then nationalities, years, offices, permits, the rest of the world.
    """
    def of(s: Column) -> Column:
        parts = F.struct(s.alias("label"), first_match(s, NATIONALITY_PATTERNS).alias("nation"), first_match(s, PERMIT_PATTERNS).alias("permit"), year_from_text(s).alias("year"))
        return let(parts, role_of)

    def role_of(p: Column) -> Column:
        label, nation, permit, year = p["label"], p["nation"], p["permit"], p["year"]
        role = lambda r, v: F.struct(F.lit(r).alias("role"), v.cast("string").alias("value"))
        return (
            F.when(nation == "TOTAL", role("total", F.lit("TOTAL")))
            .when(nation.isNotNull() & (nation != "OTHER"), role("nationality", nation))
            .when(year.isNotNull() & label.rlike(r"(?U)^(tahun\s*)?\d{4}(\s*\(\w+\))?$"), role("year", year))
            .when(label.rlike(r"(?U)kantor imigrasi|kanim\b|kelas [i]+ "), role("kanim", label))
            .when(permit.isNotNull(), role("permit", permit))
            .when(nation == "OTHER", role("nationality", nation))
            .otherwise(role("other", F.lit(None)))
        )

    return let(norm_label(text), of)


def norm_kanim(text: str | Column) -> Column:
    """Place that an immigration office's name holds."""
    bare = F.regexp_replace(norm_label(text), r"kantor imigrasi|kanim|kelas i+\b|khusus|tpi|non tpi", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def norm_unit_name(text: str | Column) -> Column:
    """Unit name without numbering, kind of unit before or after it, and footnote marks."""
    s = F.regexp_replace(norm_label(strip_tags(text)), r"^\d+\s*", "")
    s = F.regexp_replace(s, r"^(kabupaten|kab|kota adm|kota administrasi|kota|kotamadya)\s+", "")
    s = F.regexp_replace(s, r"\s*[*)(\]\[/]+\s*$", "")
    return F.trim(F.regexp_replace(s, r"\s+(kab|kabupaten|kota|regency|municipality)$", ""))


def unit_key(text: str | Column) -> Column:
    """Key to match unit names by: no spaces, aliases applied."""
    key = F.replace(norm_unit_name(text), F.lit(" "), F.lit(""))
    aliases = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, key), key)


def province_code(text: str | Column) -> Column:
    """Code of the province that a text names, with or without 'Provinsi' before it."""
    known = {re.sub(r"\s", "", name.lower()): code for code, name in PROVINCES.items()} | PROVINCE_ALIASES
    bare = F.regexp_replace(norm_label(text), r"^prov(insi)?\s+", "")
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(names, F.replace(bare, F.lit(" "), F.lit("")))


def unit_level(text: str | Column) -> Column:
    """kota, kabupaten or unknown, by how the name starts."""
    s = F.regexp_replace(norm_label(strip_tags(text)), r"^\d+\s*", "")
    return F.when(s.rlike("^kota"), "kota").when(s.rlike(r"^(kabupaten|kab\b)"), "kabupaten").otherwise("unknown")


def is_unit_name(text: str | Column) -> Column:
    """Whether a label can be a unit: letters, 45 characters at most, no survey vintage, no note."""
    s = norm_label(strip_tags(text))
    note = r"sumber|source|catatan|note|keterangan|population by|penduduk .* menurut|jumlah penduduk"
    ok = s.rlike("[a-z]") & (F.length(s) <= 45) & ~s.rlike(r"^(sp|sensus|supas|susenas)\s?\d{4}$") & ~s.rlike(note)
    return F.coalesce(ok, F.lit(False))


def title_is_about(text: str | Column, include: str, exclude: str) -> Column:
    """Whether a title matches ``include`` and not ``exclude``."""
    label = norm_label(text)
    return F.coalesce(label.rlike(include) & ~label.rlike(exclude), F.lit(False))


def only_words(text: str | Column, allowed: list[str]) -> Column:
    """Whether every word of a title is in the list or is a year."""
    words = F.filter(F.split(F.regexp_replace(norm_label(text), r"[^a-z0-9 ]+", " "), " "), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(allowed) | w.rlike(r"^(19|20)\d\d$"))


def country_group(text: str | Column) -> Column:
    """hong_kong, china or other; Taiwan is other."""
    s = norm_label(text)
    return (
        F.when(s.isNull(), None)
        .when(s.rlike(r"hong\s*kong"), "hong_kong")
        .when(s.rlike(r"taiwan|taipei"), "other")
        .when(s.rlike(r"tiongkok|\bchina\b|\bcina\b|\brrt\b"), "china")
        .otherwise("other")
    )


def ref_part(ref: str | Column, part: int) -> Column:
    """Part (from 1) of a colon-separated reference."""
    return F.split_part(_col(ref), F.lit(":"), F.lit(part))
