"""Names and codes of languages to ISO 639-3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TABLE = """af afr Afrikaans|am amh Amharic|ar ara Arabic|as asm Assamese|az aze Azerbaijani|be bel Belarusian|bg bul Bulgarian|bn ben Bengali|bo bod Tibetan|br bre Breton|bs bos Bosnian|ca cat Catalan|cs ces Czech
cy cym Welsh|da dan Danish|de deu German|dv div Dhivehi|el ell Greek|en eng English|eo epo Esperanto|es spa Spanish|et est Estonian|eu eus Basque|fa fas Persian|fi fin Finnish|fo fao Faroese|fr fra French|fy fry Frisian|ga gle Irish
gd gla Gaelic|gl glg Galician|gu guj Gujarati|ha hau Hausa|he heb Hebrew|hi hin Hindi|hr hrv Croatian|ht hat Haitian|hu hun Hungarian|hy hye Armenian|ia ina Interlingua|id ind Indonesian|ig ibo Igbo|is isl Icelandic|it ita Italian|ja jpn Japanese
jv jav Javanese|ka kat Georgian|kk kaz Kazakh|km khm Khmer|kn kan Kannada|ko kor Korean|ku kur Kurdish|ky kir Kyrgyz|la lat Latin|lb ltz Luxembourgish|ln lin Lingala|lo lao Lao|lt lit Lithuanian|lv lav Latvian|mg mlg Malagasy|mi mri Maori
mk mkd Macedonian|ml mal Malayalam|mn mon Mongolian|mr mar Marathi|ms msa Malay|mt mlt Maltese|my mya Burmese|nb nob Bokmål|ne nep Nepali|nl nld Dutch|nn nno Nynorsk|no nor Norwegian|oc oci Occitan|or ori Oriya|pa pan Punjabi|pl pol Polish
ps pus Pashto|pt por Portuguese|qu que Quechua|rm roh Romansh|ro ron Romanian|ru rus Russian|rw kin Kinyarwanda|sa san Sanskrit|sd snd Sindhi|si sin Sinhala|sk slk Slovak|sl slv Slovenian|sm smo Samoan|sn sna Shona|so som Somali|sq sqi Albanian
sr srp Serbian|su sun Sundanese|sv swe Swedish|sw swa Swahili|ta tam Tamil|te tel Telugu|tg tgk Tajik|th tha Thai|ti tir Tigrinya|tk tuk Turkmen|tl tgl Tagalog|tr tur Turkish|tt tat Tatar|ug uig Uyghur|uk ukr Ukrainian|ur urd Urdu
uz uzb Uzbek|vi vie Vietnamese|wo wol Wolof|xh xho Xhosa|yi yid Yiddish|yo yor Yoruba|zh zho Chinese|zu zul Zulu"""
_BIBLIOGRAPHIC = {"alb": "sqi", "arm": "hye", "baq": "eus", "bur": "mya", "chi": "zho", "cze": "ces", "dut": "nld", "fre": "fra", "geo": "kat", "ger": "deu", "gre": "ell", "ice": "isl", "mac": "mkd", "mao": "mri", "may": "msa", "per": "fas", "rum": "ron", "slo": "slk", "tib": "bod", "wel": "cym"}
CODES: dict[str, str] = dict(_BIBLIOGRAPHIC)
for _row in _TABLE.replace("\n", "|").split("|"):
    _two, _three, _name = _row.split(" ", 2)
    CODES |= {_two: _three, _three: _three, _name.lower(): _three}
FALLBACK = "eng"


def code_of(name: str) -> str | None:
    name = name.strip().lower()
    return CODES.get(name) or CODES.get(name.replace("_", "-").split("-")[0])


def parse_language(names: str) -> str:
    """Comma-separated names to codes: unknown ones go, repeats too, the order stays; English if none is left."""
    return ",".join(dict.fromkeys(c for c in map(code_of, names.split(",")) if c)) or FALLBACK


def language_codes(names: Column) -> Column:
    """parse_language() as an expression."""
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    name = lambda x: F.lower(F.trim(x))
    codes = F.transform(F.split(names, ",", -1), lambda x: F.coalesce(F.try_element_at(table, name(x)), F.try_element_at(table, F.split(F.translate(name(x), "_", "-"), "-", 2)[0])))
    known = F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))
    return F.when(F.size(known) > 0, F.array_join(known, ",")).otherwise(FALLBACK)
