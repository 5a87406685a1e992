"""Glyph names and their characters."""

from __future__ import annotations

_ASCII = """space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash
zero one two three four five six seven eight nine colon semicolon less equal greater question at""".split()
_CAPS, _SMALL = [chr(c) for c in range(65, 91)], [chr(c) for c in range(97, 123)]
_MORE = "bracketleft backslash bracketright asciicircum underscore grave".split()
_LAST = "braceleft bar braceright asciitilde".split()
_LATIN1 = """exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot softhyphen registered
macron degree plusminus twosuperior threesuperior acute mu paragraph periodcentered cedilla onesuperior ordmasculine guillemotright
onequarter onehalf threequarters questiondown Agrave Aacute Acircumflex Atilde Adieresis Aring AE Ccedilla Egrave Eacute Ecircumflex
Edieresis Igrave Iacute Icircumflex Idieresis Eth Ntilde Ograve Oacute Ocircumflex Otilde Odieresis multiply Oslash Ugrave Uacute
Ucircumflex Udieresis Yacute Thorn germandbls agrave aacute acircumflex atilde adieresis aring ae ccedilla egrave eacute ecircumflex
edieresis igrave iacute icircumflex idieresis eth ntilde ograve oacute ocircumflex otilde odieresis divide oslash ugrave uacute
ucircumflex udieresis yacute thorn ydieresis""".split()
_OTHER = """quoteleft ‘ quoteright ’ quotedblleft “ quotedblright ” quotesinglbase ‚ quotedblbase „ guilsinglleft ‹ guilsinglright › fi ﬁ fl ﬂ ff ﬀ ffi ﬃ
ffl ﬄ endash – emdash — dagger † daggerdbl ‡ bullet • ellipsis … perthousand ‰ fraction ⁄ florin ƒ Euro € trademark ™ circumflex ˆ tilde ˜
breve ˘ dotaccent ˙ ring ˚ hungarumlaut ˝ ogonek ˛ caron ˇ dotlessi ı Lslash Ł lslash ł OE Œ oe œ Scaron Š scaron š Zcaron Ž zcaron ž
Ydieresis Ÿ minus − notequal ≠ infinity ∞ lessequal ≤ greaterequal ≥ partialdiff ∂ summation ∑ product ∏ pi π integral ∫ Omega Ω radical √
approxequal ≈ Delta ∆ lozenge ◊ apple \uf8ff Gbreve Ğ gbreve ğ Idotaccent İ Scedilla Ş scedilla ş Cacute Ć cacute ć Ccaron Č ccaron č
dcroat đ Dcroat Đ franc ₣ Abreve Ă abreve ă Aogonek Ą aogonek ą Dcaron Ď dcaron ď Ecaron Ě ecaron ě Eogonek Ę eogonek ę Lacute Ĺ lacute ĺ
Nacute Ń nacute ń Ncaron Ň ncaron ň Ohungarumlaut Ő ohungarumlaut ő Racute Ŕ racute ŕ Rcaron Ř rcaron ř Sacute Ś sacute ś Tcaron Ť
tcaron ť Uhungarumlaut Ű uhungarumlaut ű Uring Ů uring ů Zacute Ź zacute ź Zdotaccent Ż zdotaccent ż Amacron Ā amacron ā Emacron Ē emacron ē
Imacron Ī imacron ī Omacron Ō omacron ō Umacron Ū umacron ū alpha α beta β gamma γ delta δ epsilon ε zeta ζ eta η theta θ iota ι kappa κ
lambda λ nu ν xi ξ omicron ο rho ρ sigma σ tau τ upsilon υ phi φ chi χ psi ψ omega ω Alpha Α Beta Β Gamma Γ Epsilon Ε Zeta Ζ Eta Η
Theta Θ Iota Ι Kappa Κ Lambda Λ Mu Μ Nu Ν Xi Ξ Omicron Ο Pi Π Rho Ρ Sigma Σ Tau Τ Upsilon Υ Phi Φ Chi Χ Psi Ψ arrowleft ← arrowup ↑
arrowright → arrowdown ↓ arrowboth ↔""".split()

NAMES: dict[str, str] = {n: chr(32 + i) for i, n in enumerate(_ASCII)}
NAMES |= {c: c for c in _CAPS + _SMALL} | {n: chr(0x5B + i) for i, n in enumerate(_MORE)} | {n: chr(0x7B + i) for i, n in enumerate(_LAST)}
NAMES |= {n: chr(0xA1 + i) for i, n in enumerate(_LATIN1)} | dict(zip(_OTHER[0::2], _OTHER[1::2], strict=True))
NAMES |= {"nbspace": "\xa0", "nonbreakingspace": "\xa0", "sfthyphen": "\xad", "overscore": "¯", "middot": "·", "Ohm": "Ω", "euro": "€", "idotaccent": "i"}

#: The 258 glyphs of the standard Macintosh order.
MAC_ORDER = [".notdef", ".null", "nonmarkingreturn", *_ASCII, *_CAPS, *_MORE, *_SMALL, *_LAST] + """Adieresis Aring Ccedilla Eacute Ntilde Odieresis
Udieresis aacute agrave acircumflex adieresis atilde aring ccedilla eacute egrave ecircumflex edieresis iacute igrave icircumflex idieresis
ntilde oacute ograve ocircumflex odieresis otilde uacute ugrave ucircumflex udieresis dagger degree cent sterling section bullet paragraph
germandbls registered copyright trademark acute dieresis notequal AE Oslash infinity plusminus lessequal greaterequal yen mu partialdiff
summation product pi integral ordfeminine ordmasculine Omega ae oslash questiondown exclamdown logicalnot radical florin approxequal Delta
guillemotleft guillemotright ellipsis nonbreakingspace Agrave Atilde Otilde OE oe endash emdash quotedblleft quotedblright quoteleft quoteright
divide lozenge ydieresis Ydieresis fraction currency guilsinglleft guilsinglright fi fl daggerdbl periodcentered quotesinglbase quotedblbase
perthousand Acircumflex Ecircumflex Aacute Edieresis Egrave Iacute Icircumflex Idieresis Igrave Oacute Ocircumflex apple Ograve Uacute
Ucircumflex Ugrave dotlessi circumflex tilde macron breve dotaccent ring cedilla hungarumlaut ogonek caron Lslash lslash Scaron scaron Zcaron
zcaron brokenbar Eth eth Yacute yacute Thorn thorn minus multiply onesuperior twosuperior threesuperior onehalf onequarter threequarters franc
Gbreve gbreve Idotaccent Scedilla scedilla Cacute cacute Ccaron ccaron dcroat""".split()

_CFF_ASCII = [n.replace("quotesingle", "quoteright") for n in _ASCII] + _CAPS + _MORE[:-1] + ["quoteleft"] + _SMALL + _LAST
#: The 391 standard strings of the compact font format.
CFF_STRINGS = [".notdef", *_CFF_ASCII] + """exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft
guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright
guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek
caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls onesuperior logicalnot mu trademark Eth
onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior registered minus eth multiply threesuperior
copyright Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis Igrave
Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute Ydieresis Zcaron aacute acircumflex
adieresis agrave aring atilde ccedilla eacute ecircumflex edieresis egrave iacute icircumflex idieresis igrave ntilde oacute ocircumflex
odieresis ograve otilde scaron uacute ucircumflex udieresis ugrave yacute ydieresis zcaron exclamsmall Hungarumlautsmall dollaroldstyle
dollarsuperior ampersandsmall Acutesmall parenleftsuperior parenrightsuperior twodotenleader onedotenleader zerooldstyle oneoldstyle
twooldstyle threeoldstyle fouroldstyle fiveoldstyle sixoldstyle sevenoldstyle eightoldstyle nineoldstyle commasuperior threequartersemdash
periodsuperior questionsmall asuperior bsuperior centsuperior dsuperior esuperior isuperior lsuperior msuperior nsuperior osuperior rsuperior
ssuperior tsuperior ff ffi ffl parenleftinferior parenrightinferior Circumflexsmall hyphensuperior Gravesmall Asmall Bsmall Csmall Dsmall
Esmall Fsmall Gsmall Hsmall Ismall Jsmall Ksmall Lsmall Msmall Nsmall Osmall Psmall Qsmall Rsmall Ssmall Tsmall Usmall Vsmall Wsmall Xsmall
Ysmall Zsmall colonmonetary onefitted rupiah Tildesmall exclamdownsmall centoldstyle Lslashsmall Scaronsmall Zcaronsmall Dieresissmall
Brevesmall Caronsmall Dotaccentsmall Macronsmall figuredash hypheninferior Ogoneksmall Ringsmall Cedillasmall questiondownsmall oneeighth
threeeighths fiveeighths seveneighths onethird twothirds zerosuperior foursuperior fivesuperior sixsuperior sevensuperior eightsuperior
ninesuperior zeroinferior oneinferior twoinferior threeinferior fourinferior fiveinferior sixinferior seveninferior eightinferior
nineinferior centinferior dollarinferior periodinferior commainferior Agravesmall Aacutesmall Acircumflexsmall Atildesmall Adieresissmall
Aringsmall AEsmall Ccedillasmall Egravesmall Eacutesmall Ecircumflexsmall Edieresissmall Igravesmall Iacutesmall Icircumflexsmall
Idieresissmall Ethsmall Ntildesmall Ogravesmall Oacutesmall Ocircumflexsmall Otildesmall Odieresissmall OEsmall Oslashsmall Ugravesmall
Uacutesmall Ucircumflexsmall Udieresissmall Yacutesmall Thornsmall Ydieresissmall 001.000 001.001 001.002 001.003 Black Bold Book Light
Medium Regular Roman Semibold""".split()


def _scalar(digits: str) -> str | None:
    """The character of hexadecimal digits, if there is one."""
    code = int(digits, 16) if digits and all(c in "0123456789abcdefABCDEF" for c in digits) else -1
    return chr(code) if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def glyph_to_char(name: str | None) -> str | None:
    """The character of a glyph name: listed, one visible ASCII character, uniXXXX (further digits name more glyphs), uXXXX to uXXXXXX, or so without a suffix."""
    if not name:
        return None
    if name in NAMES:
        return NAMES[name]
    if len(name) == 1 and "!" <= name <= "~":
        return name
    if name.startswith("uni") and len(name) >= 7 and (c := _scalar(name[3:7])):
        return c
    if name.startswith("u") and 5 <= len(name) <= 7 and (c := _scalar(name[1:])):
        return c
    head, dot, _ = name.partition(".")
    return glyph_to_char(head) if dot and head else None
