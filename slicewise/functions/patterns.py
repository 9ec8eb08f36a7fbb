"""Byte patterns of e-mail addresses, as Java regular expressions over Latin-1 text.

Latin-1 maps each byte to the character of the same number, so a character position in the
decoded text is a byte position in the image.
"""

from __future__ import annotations

from collections.abc import Iterable

# The top-level domains that the scanners accept.
TLDS = tuple(
    """
    AC AD AE AERO AF AG AI AL AM AN AO AQ AR ARPA AS ASIA AT AU AW AX AZ BA BB BD BE BF BG BH BI BIZ BJ BL BM BN
    BO BR BS BT BV BW BY BZ CA CAT CC CD CF CG CH CI CK CL CM CN CO COM COOP CR CU CV CX CY CZ DE DJ DK DM DO DZ
    EC EDU EE EG EH ER ES ET EU FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GOV GP GQ GR GS GT GU GW GY HK
    HM HN HR HT HU ID IE IL IM IN INFO INT IO IQ IR IS IT JE JM JO JOBS JP KE KG KH KI KM KN KP KR KW KY KZ LA LB
    LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MIL MK ML MM MN MO MOBI MP MQ MR MS MT MU MUSEUM MV MW MX MY
    MZ NA NAME NC NE NET NF NG NI NL NO NP NR NU NZ OM ORG PA PE PF PG PH PK PL PM PN PR PRO PS PT PW PY QA RE RO
    RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR ST SU SV SY SZ TC TD TEL TF TG TH TJ TK TL TM TN TO TP
    TR TRAVEL TT TV TW TZ UA UG UK UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT YU ZA ZM ZW
    """.split()
)

# Length limits of the address parts, in characters.
LEXER_PART = 64
ANCHOR_LOCAL = 64
ANCHOR_DOMAIN = 256


def default_tlds() -> tuple[str, ...]:
    """Top-level domains accepted by the scanners unless others are given."""
    return TLDS


def alternation(names: Iterable[str], after_each: str = "") -> str:
    """A regex for any of `names`, grouped by first letter so that few branches are tried.

    `after_each` follows every letter (a NUL byte for UTF-16LE).
    """
    by_letter: dict[str, list[str]] = {}
    for name in sorted(set(names)):
        by_letter.setdefault(name[0], []).append(name[1:])
    branches = []
    for letter, rests in by_letter.items():
        long = sorted((r for r in rests if len(r) != 1), key=len, reverse=True)
        options = ["".join(c + after_each for c in rest) for rest in long]
        single = "".join(r for r in rests if len(r) == 1)
        if single:
            options.append(f"[{single}]{after_each}")
        branches.append(f"{letter}{after_each}(?:{'|'.join(options)})")
    return f"(?i:{'|'.join(branches)})"


class LexerPatterns:
    """Address of the lexer rule: bounded parts and a required byte behind the domain."""

    # Bytes and lengths of the parts; \x00 follows every byte in UTF-16LE.
    LOCAL8 = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{1,64}\z"
    LOCAL16 = r"[A-Za-z0-9]\x00(?:[A-Za-z0-9._%+\-]\x00){1,64}\z"
    #: longest local part in bytes, 8-bit and UTF-16
    LOCAL_BYTES = 2 * (LEXER_PART + 1)

    def __init__(self, utf16: bool = True, tlds: Iterable[str] | None = None):
        names = tuple(n.upper() for n in tlds) if tlds is not None else default_tlds()
        #: bytes behind the @ that decide: domain, dot, top-level domain and what must follow
        self.domain_bytes = 2 * (1 + LEXER_PART + 1 + max(map(len, names))) + 2
        rules = [rf"[A-Za-z0-9._%\-]{{1,64}}\.{alternation(names)}(?=[^A-Za-z])"]
        if utf16:
            rules.append(
                rf"\x00(?:[A-Za-z0-9._%\-]\x00){{1,64}}\.\x00{alternation(names, chr(92) + 'x00')}"
                r"(?=[^A-Za-z]|[\s\S][^\x00])"
            )
        self.domain = rf"\A(?:{'|'.join(rules)})"
        nul = r"\x00?" if utf16 else ""
        self.anchor = rf"@(?<=[A-Za-z0-9._%+\-]{nul}@)(?={'|'.join(rules)})"


class AnchorPatterns:
    """Address of the anchor rule: the maximal run of valid bytes on each side of an @."""

    LOCAL_BYTES = 2 * (ANCHOR_LOCAL + 1)
    DOMAIN_BYTES = 2 * (ANCHOR_DOMAIN + 1) + 2

    def __init__(self, allow_space: bool = False, utf16: bool = True, tlds: Iterable[str] | None = None):
        names = tuple(n.upper() for n in tlds) if tlds is not None else default_tlds()
        valid = address_class(allow_space)
        self.local8 = rf"{valid}*\z"
        self.local16 = rf"(?:{valid}\x00)*\z"
        rules = [rf"(?!\x00){valid}{{0,255}}\.{alternation(names)}(?!{valid})"]
        if utf16:
            rules.append(
                rf"\x00(?:{valid}\x00){{0,255}}\.\x00{alternation(names, chr(92) + 'x00')}(?!{valid}\x00)"
            )
        self.domain = rf"\A(?:{'|'.join(rules)})"
        nul = r"\x00?" if utf16 else ""
        self.anchor = rf"@(?<={valid}{nul}@)(?={'|'.join(rules)})"


def address_class(allow_space: bool = False) -> str:
    """Regex class of the bytes an address part may hold."""
    # Printable bytes and 0x7f, but for the separators of an address.
    low = "20" if allow_space else "21"
    return rf'[\x{low}-\x7f&&[^"(),:;<>@\[\]\\]]'
