"""Sentence rules as cascading tables of break and no-break pairs.

A rule looks at what stands before a position and at what follows it. Tables are gone through in
order and the first rule that fits decides the position. ``COMMON_FIRST`` holds what is true in every
language, then come the tables of the languages a text is written in, then ``COMMON_LAST``. What needs a view of
more than a position's surroundings, quotations and paragraphs without capitals, is found in one pass over a
text beforehand (``segmentation``), so no rule looks further than a few words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Classes of characters.
TERMINAL = ".!?…。！？｡．।॥؟۔‼⁇⁈⁉"
CLOSE = "\"'”’»›」』）】〕》〉)\\]}"
OPEN = "\"'“‘„«‹»「『（【〔《〈(\\[{¿¡"
EMOJI = r"(?:\p{Extended_Pictographic}[️‍\p{Emoji_Modifier}\p{Extended_Pictographic}]*)"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}"
FILE = r"(?:[\p{L}_][\p{L}\p{N}_\-]*/)*[\p{L}_][\p{L}\p{N}_\-]+\.[\p{L}\p{N}][\p{L}\p{N}._/\-]*|[\p{Ll}]+_[\p{L}\p{N}_]+"
#: How a sentence can begin, after white space and opening marks.
START = rf"(?:[{OPEN}]*(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]|(?:{FILE})(?![\p{{L}}\p{{N}}])))"
#: A mark that closes. A closing “ of „…“ is read as ”.
CLOSER = rf"[{CLOSE}]"


@dataclass(frozen=True)
class Rule:
    """``breaks`` where ``before`` ends and ``after`` begins."""

    breaks: bool
    before: str
    after: str


#: The last word of every abbreviation of the tables.
ABBREVIATIONS: set[str] = set()


def words(*names: str) -> str:
    """One of the names as a whole word with a full stop."""
    ABBREVIATIONS.update(re.split(r"[.\s-]+", n)[-1] for n in names)
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(n.replace(".", r"\.").replace(" ", r"\s?") for n in names) + r")\."


#: What follows an abbreviation, also where the space is missing.
SOON = r"[\s\p{L}\p{N}]"

COMMON_FIRST = (
    # A quotation that its sentence runs on after.
    Rule(False, CLOSER, r"\s*[,;:，；：、，؛]"),
    # Within an abbreviation of several letters.
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{L}\.", r"\s?\p{L}\."),
    # An ellipsis ends a sentence only before a capital.
    Rule(True, rf"(?:…+|\.{{3,}}){CLOSER}*", rf"\s*[{OPEN}]*[\p{{Lu}}\p{{Lt}}]"),
    Rule(False, rf"(?:…+|\.{{3,}}){CLOSER}*", r".|\s"),
)

# Abbreviations, words that begin sentences, and months.
STARTERS = "The This That These Those There Then It Its He She We They I You His Her Our Their In On At After Before When While If Since For From But And So No Nothing Please What Why How Who Where Which".split()
#: A capitalised word that is no usual beginning of a sentence, or what can't be one.
NAME = r"\s+(?!(?:" + "|".join(STARTERS) + r")(?!\p{L}))[\p{L}\p{N}(]"

ENGLISH = (
    Rule(False, words("Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "Gen", "Col", "Maj", "Capt", "Lt", "Sgt", "Cpl", "Cmdr", "Adm", "Sen", "Rep", "Gov", "Pres", "St", "Mt", "Rev", "Hon", "Messrs", "vs", "cf", "ca", "approx", "i.e", "e.g", "viz", "resp", "incl", "est"), SOON),
    Rule(False, words("No", "Nos", "Fig", "Figs", "Eq", "Eqs", "Sec", "Secs", "Ch", "Vol", "Tab", "Ref", "Refs", "Art", "Pt", "App", "ext", "p", "pp", "l", "ll", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"), r"\s+[\p{N}(]"),
    # What may also end a sentence.
    Rule(False, words("Corp", "Inc", "Ltd", "Co", "Bros", "Jr", "Sr", "Dept", "Univ", "Assn", "Ave", "Blvd", "Rd"), NAME),
    Rule(False, r"(?<![\p{L}\p{N}])(?:\p{Lu}\.){2,}", NAME),
    # Initials of names.
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

GERMAN = (
    Rule(False, words("z. B", "d. h", "u. a", "u. U", "i. d. R", "z. T", "v. a", "o. g", "s. o", "s. u", "Hr", "Fr", "Dr", "Prof", "St", "Dipl", "Ing", "bzw", "vgl", "evtl", "ggf", "inkl", "exkl", "ca", "sog", "bspw", "zzgl", "Str"), SOON),
    Rule(False, words("Nr", "Abb", "Abschn", "Kap", "Bd", "Tab", "Bsp", "S", "Anm", "Gl", "Art", "Abs", "mind", "max", "min", "Jan", "Feb", "Apr", "Aug", "Sept", "Okt", "Nov", "Dez"), r"\s+\p{N}"),
    Rule(False, r"(?<!\p{L})\p{N}{1,2}\.", r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)(?!\p{L})"),
    Rule(False, r"(?<!\p{L})(?:am|vom|zum|zur|beim|im|ab|seit|dem|den|der|die|das|des|jede[mnrs]?|diese[mnrs]?|Am|Vom|Zum|Im|Ab|Seit|Dem|Den|Der|Die|Das|Des)\s+\p{N}{1,2}\.", r"\s+\p{L}"),
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

SPANISH = (
    Rule(False, words("Sr", "Sra", "Srta", "Sres", "Dr", "Dra", "Dres", "Prof", "Lic", "Ing", "Arq", "Ud", "Uds", "D", "Dña", "p. ej", "EE", "aprox"), SOON),
    Rule(False, words("núm", "núms", "n", "nº", "pág", "págs", "p", "pp", "fig", "figs", "cap", "vol", "art", "sec", "Núm", "Fig", "Pág", "Cap", "Sec", "tel", "Tel"), r"\s+\p{N}"),
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

FRENCH = (
    Rule(False, words("M", "MM", "Me", "Dr", "Pr", "Prof", "St", "Ste", "p. ex", "c.-à-d", "cf", "env", "av", "apr", "J.-C", "Cie"), SOON),
    Rule(False, words("art", "chap", "fig", "n", "no", "nos", "vol", "p", "pp", "éd", "réf", "tél", "Art", "Chap", "Fig", "No", "Vol", "Réf", "Tél", "janv", "févr", "juil", "sept", "oct", "nov", "déc"), r"\s+\p{N}"),
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

ITALIAN = (
    Rule(False, words("Sig", "Sig.ra", "Sig.na", "Sigg", "Dott", "Dott.ssa", "Dr", "Prof", "Prof.ssa", "Ing", "Avv", "Arch", "Geom", "Rag", "On", "p. es", "ad es", "cfr", "ca"), SOON),
    Rule(False, words("pag", "pagg", "p", "pp", "art", "artt", "cap", "fig", "figg", "vol", "tel", "n", "nr", "Pag", "Art", "Cap", "Fig", "Vol", "Tel", "N"), r"\s+\p{N}"),
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

PORTUGUESE = (
    Rule(False, words("Sr", "Sra", "Srta", "Srs", "Dr", "Dra", "Prof", "Profa", "Eng", "Exmo", "Exma", "p. ex", "aprox", "Av"), SOON),
    Rule(False, words("pág", "págs", "p", "pp", "fig", "figs", "art", "cap", "núm", "n", "vol", "tel", "Pág", "Fig", "Art", "Cap", "Vol", "Tel"), r"\s+\p{N}"),
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

RUSSIAN = (
    Rule(False, words("т. е", "т. к", "т. н", "т. о", "и. о", "напр", "проф", "акад", "доц", "им", "ул", "пр", "пл", "св", "см", "ср", "г-н", "Проф", "Акад", "См"), SOON),
    Rule(False, words("д", "кв", "стр", "с", "рис", "табл", "гл", "п", "пп", "тел", "Рис", "Табл", "Гл"), r"\s+\p{N}"),
    Rule(False, r"(?<![\p{L}\p{N}.])(?<!\p{N}\s)\p{Lu}\.", r"\s+\p{Lu}"),
)

CHINESE = ()

JAPANESE = (
    Rule(False, r"[」』]", r"(?:と|って|を|が|は|に|の|で|も|や|へ|か|、)"),
)

HINDI = (
    Rule(False, words("डॉ", "प्रो", "श्री", "सुश्री", "पं", "कृ", "क्र", "सं", "रु"), r"\s"),
    Rule(True, rf"[।॥]+{CLOSER}*", r".|\s"),
)

ARABIC = (
    # Titles of one letter.
    Rule(False, r"(?<!\p{L})\p{Arabic}\.", r"\s"),
    Rule(False, words("أ.د", "ص.ب", "ق.م"), r"\s"),
    Rule(True, rf"[؟۔][!?.؟]*{CLOSER}*", r".|\s"),
    Rule(True, r"\p{Arabic}{2}\.", r"\p{Arabic}"),
)

THAI = (
    Rule(False, r"(?<!\p{Thai})(?:ดร|ผศ|รศ|ศ|นพ|พญ|พ\.ศ|ค\.ศ|ก\.ม|ม|น|ต|อ|จ|ถ)\.", r"\s"),
    Rule(False, r"[ๆฯ]", r"\s"),
    # A space between words is the only mark of a sentence's end.
    Rule(True, r"\p{Thai}", rf"\s+[{OPEN}]*[\p{{Thai}}{UNSPACED}\p{{Arabic}}\p{{Devanagari}}]"),
    Rule(True, r"\p{Thai}", rf"\s+[{OPEN}]*\p{{Lu}}\p{{L}}*[’']?\p{{L}}*[,:]?\s+\p{{Ll}}"),
)

COMMON_LAST = (
    Rule(True, rf"[。！？｡．‼⁇⁈⁉]+{CLOSER}*", r".|\s"),
    Rule(True, EMOJI, rf"\s+{START}|\p{{Lu}}"),
    Rule(True, rf"[!?]+{CLOSER}*", rf"\s+{START}|[{OPEN}]*[\p{{Lu}}\p{{Lo}}]"),
    Rule(True, rf"\.{CLOSER}*", rf"\s+{START}"),
    # A full stop without a space: a word or number before it, a capitalised word after.
    Rule(True, rf"(?:\p{{Ll}}{{2}}|[\p{{N}}%)\"”’]|\.m|\s\p{{Ll}})\.{CLOSER}*", rf"[{OPEN}]*\p{{Lu}}(?:[\p{{L}}\s'’]|\.\s)"),
)

#: In a paragraph without capitals case tells nothing.
CASELESS = Rule(True, rf"[.!?]{CLOSER}*", rf"\s+[{OPEN}]*\p{{Ll}}")

TABLES: dict[str, tuple[Rule, ...]] = {
    "en": ENGLISH, "de": GERMAN, "es": SPANISH, "fr": FRENCH, "it": ITALIAN, "pt": PORTUGUESE, "ru": RUSSIAN,
    "zh": CHINESE, "ja": JAPANESE, "hi": HINDI, "ar": ARABIC, "th": THAI,
}

# Words that tell the languages of one script apart.
TELLING = {
    "en": "the of and to is are were that with this it we he she they you not but have has had be by from or which when so then than there its their our after before into about under over only any all nobody nothing stayed",
    "de": "der und ist nicht mit ein eine einen auf dem wurde wird von zu im für auch sich nach bei wir ich oder aber noch nur wie sind haben siehe zum zur hat habe wurden dann dass",
    "es": "el los las una que en con por para del al está fue pero como más muy y se lo su",
    "fr": "le les des une du est pas pour dans que qui sur au aux avec ce cette et ne sont vous nous",
    "it": "il di che è per non una del della dei con sono gli nel alla anche ma si",
    "pt": "os uma é não com para que em do da dos das ao pela pelo mas foi",
    "ru": "и в не на что с по из это как для",
}

#: The scripts that only one of the languages is written in, or that its table asks for.
SCRIPTS = {"zh": r"\p{Han}", "ja": r"[\p{Hiragana}\p{Katakana}]", "hi": r"\p{Devanagari}", "ar": r"\p{Arabic}", "th": r"\p{Thai}"}

#: Positions worth asking the rules about: after final marks with what closes, after emoji, after a Thai word.
CANDIDATE = rf"[{TERMINAL}]+{CLOSER}*(?:\s*{EMOJI})*|{EMOJI}|[\p{{Thai}}ๆฯ](?=\s)"
PLAIN_CANDIDATE = r"[.!?]+[\"')\]}]*"

#: Marks of list items, at the start of a line.
BULLET = r"[^\S\r\n]*(?:[•‣◦▪●○·∙*–—\-])[^\S\r\n]+(?=\S)"
NUMBERED = r"[^\S\r\n]*\(?(?P<n>\d{1,3}|[^\W\d_])[.)）、][^\S\r\n]+(?=\S)"
