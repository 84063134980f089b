"""Sentence boundaries of Unicode text (Unicode Standard Annex 29, no locale tailoring), as one pattern.

The rules decide after each stop, with what closes it and the blanks behind it, whether
a sentence ends.  They are written as lookarounds over character classes, so that a text
is marked in one pass and each stop looks no further than the next stop.  Stops of
scripts outside the basic plane (ancient ones, mostly) are not listed; the signs that
stand before Arabic numbers count as format characters.
"""

from __future__ import annotations

#: Characters of the Unicode property Sentence_Break, as class bodies (fixed values).  Extend and Format are one: both are looked through.
EXTEND = r"\p{Mn}\p{Me}\p{Mc}\p{Cf}\x{FF9E}\x{FF9F}"
FULL_STOP = r".\x{2024}\x{FE52}\x{FF0E}"
STOP = (
    r"!?\x{589}\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{7F9}\x{837}\x{839}\x{83D}\x{83E}\x{964}\x{965}\x{104A}\x{104B}"
    r"\x{1362}\x{1367}\x{1368}\x{166E}\x{1735}\x{1736}\x{17D4}\x{17D5}\x{1803}\x{1809}\x{1944}\x{1945}\x{1AA8}-\x{1AAB}\x{1B4E}\x{1B4F}"
    r"\x{1B5A}\x{1B5B}\x{1B5E}\x{1B5F}\x{1B7D}-\x{1B7F}\x{1C3B}\x{1C3C}\x{1C7E}\x{1C7F}\x{203C}\x{203D}\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}"
    r"\x{2E2E}\x{2E3C}\x{2E53}\x{2E54}\x{3002}\x{A4FF}\x{A60E}\x{A60F}\x{A6F3}\x{A6F7}\x{A876}\x{A877}\x{A8CE}\x{A8CF}\x{A92F}\x{A9C8}\x{A9C9}"
    r"\x{AA5D}-\x{AA5F}\x{AAF0}\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}\x{FE16}\x{FE56}\x{FE57}\x{FF01}\x{FF1F}\x{FF61}"
)
GOES_ON = r",\-:;\x{37E}\x{55D}\x{60C}\x{60D}\x{7F8}\x{1802}\x{1808}\x{2013}\x{2014}\x{3001}\x{FE10}\x{FE11}\x{FE13}\x{FE14}\x{FE31}\x{FE32}\x{FE50}\x{FE51}\x{FE54}\x{FE55}\x{FE58}\x{FE63}\x{FF0C}\x{FF0D}\x{FF1A}\x{FF1B}\x{FF64}"
CLOSE = r"\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"'\x{275B}-\x{2760}\x{2E00}-\x{2E0D}\x{1F676}-\x{1F678}"
NUMERIC = r"\p{Nd}\x{66B}\x{66C}"
NEXT_LINE = r"\x{85}"
#: Letters by case, with Java's intersections: Georgian letters count as neither case.
LOWER = r"[\p{IsLowercase}&&[^\x{345}\x{10D0}-\x{10FA}\x{10FD}-\x{10FF}]]"
UPPER = r"[\p{Lt}\p{IsUppercase}&&[^\x{1C90}-\x{1CBA}\x{1CBD}-\x{1CBF}]]"
NO_LETTER = rf"[[^\p{{IsAlphabetic}}\x{{5F3}}{NEXT_LINE}{FULL_STOP}{STOP}]{EXTEND}]"
#: Marks between a letter and its full stop, and behind that, that rule 7 looks through.
MARKS = 9

#: A class of many ranges is looked at only where a few comparisons leave it open: no ASCII character extends, no blank, ASCII letter or digit closes or goes on.
_ODD, _SIGN = r"(?=[^\x00-\x7F])", r"(?=[^ A-Za-z0-9])"
_EXTENDED = rf"(?:{_ODD}[{EXTEND}]++)?+"
_TAIL = rf"(?:{_SIGN}[{CLOSE}{EXTEND}]++)?+(?: {_ODD}[{EXTEND}]++)*+"
_BEHIND = rf"(?!{_SIGN}[{GOES_ON}{FULL_STOP}{STOP}{NEXT_LINE}])"
_LETTER_BEFORE = rf"[{LOWER}{UPPER}][{EXTEND}]{{0,{MARKS}}}"
_ABBREVIATED = rf"(?>(?<=[A-Za-z])|(?<=[^\x00-\x7F])(?<={_LETTER_BEFORE}))"
_NO_LETTER_BEFORE = rf"(?<![A-Za-z])(?:(?<![^\x00-\x7F])|(?<!{_LETTER_BEFORE}))"
_FULL_STOP = rf"(?=[{FULL_STOP}])(?:{_ABBREVIATED}[{FULL_STOP}]{_EXTENDED}(?!(?=[A-Z\x{{80}}-\x{{10FFFF}}]){UPPER})|{_NO_LETTER_BEFORE}[{FULL_STOP}]{_EXTENDED})(?!(?=[0-9\x{{80}}-\x{{10FFFF}}])[{NUMERIC}])"
_STOP = r".\x{2024}\x{FE52}\x{FF0E}"
STOP = (
    r"!?\x{589}\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{7F9}\x{837}\x{839}\x{83D}\x{83E}\x{964}\x{965}\x{104A}\x{104B}"
    r"\x{1362}\x{1367}\x{1368}\x{166E}\x{1735}\x{1736}\x{17D4}\x{17D5}\x{1803}\x{1809}\x{1944}\x{1945}\x{1AA8}-\x{1AAB}\x{1B4E}\x{1B4F}"
    r"\x{1B5A}\x{1B5B}\x{1B5E}\x{1B5F}\x{1B7D}-\x{1B7F}\x{1C3B}\x{1C3C}\x{1C7E}\x{1C7F}\x{203C}\x{203D}\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}"
    r"\x{2E2E}\x{2E3C}\x{2E53}\x{2E54}\x{3002}\x{A4FF}\x{A60E}\x{A60F}\x{A6F3}\x{A6F7}\x{A876}\x{A877}\x{A8CE}\x{A8CF}\x{A92F}\x{A9C8}\x{A9C9}"
    r"\x{AA5D}-\x{AA5F}\x{AAF0}\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}\x{FE16}\x{FE56}\x{FE57}\x{FF01}\x{FF1F}\x{FF61}"
)
GOES_ON = r",\-:;\x{37E}\x{55D}\x{60C}\x{60D}\x{7F8}\x{1802}\x{1808}\x{2013}\x{2014}\x{3001}\x{FE10}\x{FE11}\x{FE13}\x{FE14}\x{FE31}\x{FE32}\x{FE50}\x{FE51}\x{FE54}\x{FE55}\x{FE58}\x{FE63}\x{FF0C}\x{FF0D}\x{FF1A}\x{FF1B}\x{FF64}"
CLOSE = r"\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"'\x{275B}-\x{2760}\x{2E00}-\x{2E0D}\x{1F676}-\x{1F678}"
NUMERIC = r"\p{Nd}\x{66B}\x{66C}"
NEXT_LINE = r"\x{85}"
#: Letters by case, with Java's intersections: Georgian letters count as neither case.
LOWER = r"[\p{IsLowercase}&&[^\x{345}\x{10D0}-\x{10FA}\x{10FD}-\x{10FF}]]"
UPPER = r"[\p{Lt}\p{IsUppercase}&&[^\x{1C90}-\x{1CBA}\x{1CBD}-\x{1CBF}]]"
NO_LETTER = rf"[[^\p{{IsAlphabetic}}\x{{5F3}}{NEXT_LINE}{FULL_STOP}{STOP}]{EXTEND}]"
#: Marks between a letter and its full stop, and behind that, that rule 7 looks through.
MARKS = 9

#: A class of many ranges is looked at only where a few comparisons leave it open: no ASCII character extends, no blank, ASCII letter or digit closes or goes on.
_ODD, _SIGN = r"(?=[^\x00-\x7F])", r"(?=[^ A-Za-z0-9])"
_EXTENDED = rf"(?:{_ODD}[{EXTEND}]++)?+"
_TAIL = rf"(?:{_SIGN}[{CLOSE}{EXTEND}]++)?+(?: {_ODD}[{EXTEND}]++)*+"
_BEHIND = rf"(?!{_SIGN}[{GOES_ON}{FULL_STOP}{STOP}{NEXT_LINE}])"
_ABBREVIATED = rf"(?:(?<=[A-Za-z])|(?<=[{LOWER}{UPPER}][{EXTEND}]{{0,{MARKS}}}))"
_NO_LETTER_BEFORE = rf"(?<![A-Za-z])(?<![{LOWER}{UPPER}][{EXTEND}]{{0,{MARKS}}})"
_FULL_STOP = rf"(?:{_ABBREVIATED}[{FULL_STOP}]{_EXTENDED}(?!(?=[A-Z\x{{80}}-\x{{10FFFF}}]){UPPER})|{_NO_LETTER_BEFORE}[{FULL_STOP}]{_EXTENDED})(?!(?=[0-9\x{{80}}-\x{{10FFFF}}])[{NUMERIC}])"
_STOP = rf"(?:[!?\x{{3002}}\x{{FF01}}\x{{FF1F}}\x{{FF61}}]|(?=[\x{{589}}-\x{{FE57}}])[{STOP}])"
_GOES_ON_SMALL = rf"(?!(?=[^A-Z])(?:[a-z]|{NO_LETTER}*+{LOWER}))"

#: What ends a sentence: groups 1 to 3 are kept (one matches), the blank behind them is not.
#: White space is taken to be collapsed.  The first look tells most characters by two comparisons.
SENTENCE_END = (
    rf"(?=[!.?{NEXT_LINE}\x{{589}}-\x{{10FFFF}}])(?:"
    rf"({_STOP}{_TAIL}) ?+{_BEHIND}"
    rf"|({_FULL_STOP}{_TAIL}) ?+{_GOES_ON_SMALL}{_BEHIND}"
    rf"|({NEXT_LINE}) ?)"
)
