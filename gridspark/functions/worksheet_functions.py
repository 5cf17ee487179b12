"""The table of worksheet functions that formula tokens name by number.

Numbers count up along the public list of functions of the binary formats (Ftab), so a run of
the list is its first number and its names; a slash gives the number of arguments of a function
that always has as many, which its token leaves out. Functions of macro sheets are left out, and
so the runs break there. ``load`` completes or replaces the list from any text whose lines hold
a hexadecimal id and a name (a specification's table, a CSV): ``0x00DB | ADDRESS | ... | 2``.
"""

from __future__ import annotations

import re
from pathlib import Path

# Runs of the public list, names in its order. The last runs are of newer functions.
RUNS = """
0000 COUNT IF ISNA/1 ISERROR/1 SUM AVERAGE MIN MAX ROW COLUMN NA/0 NPV STDEV DOLLAR FIXED SIN/1
0010 COS/1 TAN/1 ATAN/1 PI/0 SQRT/1 EXP/1 LN/1 LOG10/1 ABS/1 INT/1 SIGN/1 ROUND/2 LOOKUP INDEX REPT/2 MID/3
0020 LEN/1 VALUE/1 TRUE/0 FALSE/0 AND OR NOT/1 MOD/2 DCOUNT/3 DSUM/3 DAVERAGE/3 DMIN/3 DMAX/3 DSTDEV/3 VAR DVAR/3
0030 TEXT/2 LINEST TREND LOGEST GROWTH
0038 PV FV NPER PMT RATE MIRR/3 IRR RAND/0
0040 MATCH DATE/3 TIME/3 DAY/1 MONTH/1 YEAR/1 WEEKDAY HOUR/1 MINUTE/1 SECOND/1 NOW/0 AREAS/1 ROWS/1 COLUMNS/1 OFFSET
0052 SEARCH TRANSPOSE/1
0056 TYPE/1
0061 ATAN2/2 ASIN/1 ACOS/1 CHOOSE HLOOKUP VLOOKUP
0069 ISREF/1
006D LOG
006F CHAR/1 LOWER/1 UPPER/1 PROPER/1 LEFT RIGHT EXACT/2 TRIM/1 REPLACE/4 SUBSTITUTE CODE/1
007C FIND CELL ISERR/1 ISTEXT/1 ISNUMBER/1 ISBLANK/1 T/1 N/1
008C DATEVALUE/1 TIMEVALUE/1 SLN/3 SYD/4 DDB
0094 INDIRECT
00A2 CLEAN/1 MDETERM/1 MINVERSE/1 MMULT/2
00A7 IPMT PPMT COUNTA
00B7 PRODUCT FACT/1
00BD DPRODUCT/3 ISNONTEXT/1
00C1 STDEVP VARP DSTDEVP/3 DVARP/3 TRUNC ISLOGICAL/1 DCOUNTA/3
00CC USDOLLAR FINDB SEARCHB REPLACEB/4 LEFTB RIGHTB MIDB/3 LENB/1 ROUNDUP/2 ROUNDDOWN/2 ASC/1 DBCS/1 RANK
00DB ADDRESS DAYS360 TODAY/0 VDB
00E3 MEDIAN SUMPRODUCT SINH/1 COSH/1 TANH/1 ASINH/1 ACOSH/1 ATANH/1 DGET/3
00F4 INFO/1
00F7 DB
00FC FREQUENCY/2
0105 ERROR.TYPE/1
010D AVEDEV BETADIST GAMMALN/1 BETAINV BINOMDIST/4 CHIDIST/2 CHIINV/2 COMBIN/2 CONFIDENCE/3 CRITBINOM/3 EVEN/1 EXPONDIST/3 FDIST/3 FINV/3 FISHER/1
011C FISHERINV/1 FLOOR/2 GAMMADIST/4 GAMMAINV/3 CEILING/2 HYPGEOMDIST/4 LOGNORMDIST/3 LOGINV/3 NEGBINOMDIST/3 NORMDIST/4 NORMSDIST/1 NORMINV/3 NORMSINV/1
0129 STANDARDIZE/3 ODD/1 PERMUT/2 POISSON/3 TDIST/3 WEIBULL/4 SUMXMY2/2 SUMX2MY2/2 SUMX2PY2/2 CHITEST/2 CORREL/2 COVAR/2 FORECAST/3 FTEST/2 INTERCEPT/2
0138 PEARSON/2 RSQ/2 STEYX/2 SLOPE/2 TTEST/4 PROB DEVSQ GEOMEAN HARMEAN SUMSQ KURT SKEW ZTEST LARGE/2 SMALL/2 QUARTILE/2 PERCENTILE/2 PERCENTRANK MODE
014B TRIMMEAN/2 TINV/2
0150 CONCATENATE POWER/2
0156 RADIANS/1 DEGREES/1 SUBTOTAL SUMIF COUNTIF COUNTBLANK/1
015E ISPMT/4 DATEDIF/3 DATESTRING/1 NUMBERSTRING/2 ROMAN
0166 GETPIVOTDATA HYPERLINK PHONETIC/1 AVERAGEA MAXA MINA STDEVPA VARPA STDEVA VARA BAHTTEXT/1 THAIDAYOFWEEK/1 THAIDIGIT/1 THAIMONTHOFYEAR/1
0174 THAINUMSOUND/1 THAINUMSTRING/1 THAISTRINGLENGTH/1 ISTHAIDIGIT/1 ROUNDBAHTDOWN/1 ROUNDBAHTUP/1 THAIYEAR/1 RTD CUBEVALUE CUBEMEMBER
017E CUBEMEMBERPROPERTY/3 CUBERANKEDMEMBER HEX2BIN HEX2DEC/1 HEX2OCT DEC2BIN DEC2HEX DEC2OCT OCT2BIN OCT2HEX OCT2DEC/1 BIN2DEC/1 BIN2OCT BIN2HEX
018C IMSUB/2 IMDIV/2 IMPOWER/2 IMABS/1 IMSQRT/1 IMLN/1 IMLOG2/1 IMLOG10/1 IMSIN/1 IMCOS/1 IMEXP/1 IMARGUMENT/1 IMCONJUGATE/1 IMAGINARY/1 IMREAL/1
019B COMPLEX IMSUM IMPRODUCT SERIESSUM/4 FACTDOUBLE/1 SQRTPI/1 QUOTIENT/2 DELTA GESTEP ISEVEN/1 ISODD/1 MROUND/2 ERF ERFC/1
01A9 BESSELJ/2 BESSELK/2 BESSELY/2 BESSELI/2 XIRR XNPV/3 PRICEMAT YIELDMAT INTRATE RECEIVED DISC PRICEDISC YIELDDISC TBILLEQ/3 TBILLPRICE/3 TBILLYIELD/3
01B9 PRICE YIELD DOLLARDE/2 DOLLARFR/2 NOMINAL/2 EFFECT/2 CUMPRINC/6 CUMIPMT/6 EDATE/2 EOMONTH/2 YEARFRAC COUPDAYBS COUPDAYS COUPDAYSNC COUPNCD COUPNUM
01C9 COUPPCD DURATION MDURATION ODDLPRICE ODDLYIELD ODDFPRICE ODDFYIELD RANDBETWEEN/2 WEEKNUM AMORDEGRC AMORLINC CONVERT/3 ACCRINT ACCRINTM
01D7 WORKDAY NETWORKDAYS GCD MULTINOMIAL LCM FVSCHEDULE/2 CUBEKPIMEMBER CUBESET CUBESETCOUNT/1 IFERROR/2 COUNTIFS SUMIFS AVERAGEIF AVERAGEIFS
0213 IFNA/2 IFS SWITCH MAXIFS MINIFS
0241 XLOOKUP
0244 XMATCH
0246 FILTER SORT SORTBY UNIQUE SEQUENCE RANDARRAY LET
"""
#: Arguments that a token without a count takes if its function may have several numbers of them.
SHORTEST = {"WEEKDAY": 1, "LOG": 2, "TRUNC": 1, "DAYS360": 2, "BETADIST": 3, "BETAINV": 3, "CONCATENATE": 2}

_LINE = re.compile(r"(?:0x)?([0-9A-Fa-f]{4})\W+([A-Z][A-Z0-9_.]*)(.*)")


def runs(text: str) -> dict[int, tuple[str, int | None]]:
    """id -> (name, number of arguments or None) from runs of a list."""
    table: dict[int, tuple[str, int | None]] = {}
    for line in text.split("\n"):
        first, *names = line.split() or [""]
        for k, name in enumerate(names):
            name, _, count = name.partition("/")
            table[int(first, 16) + k] = (name, int(count) if count else SHORTEST.get(name))
    return table


def parse(text: str) -> dict[int, tuple[str, int | None]]:
    """id -> (name, number of arguments or None) from lines with an id and a name; later lines win."""
    table: dict[int, tuple[str, int | None]] = {}
    for line in text.splitlines():
        if m := _LINE.search(line):
            count = re.search(r"(?<![\w.:-])(\d{1,2})(?![\w.:-])", m[3])
            table[int(m[1], 16)] = (m[2], int(count[1]) if count else None)
    return table


def load(path: str | None = None) -> dict[int, tuple[str, int | None]]:
    """The built-in table, completed by the one at ``path``; counts known here stay."""
    own = runs(RUNS)
    if path is None:
        return own
    more = parse(Path(path).read_text(encoding="utf-8"))
    return more | {k: (more.get(k, own[k])[0], own[k][1] if own[k][1] is not None or k not in more else more[k][1]) for k in own}
