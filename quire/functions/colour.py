"""Colour conversions as column expressions; components lie from 0 to 1."""

from pyspark.sql import functions as F

#: 255 times the coefficients of red, green and blue in c, m, y, k, beside a constant of 1.
CMYK_POLYNOMIAL = {
    "cc": (-4.387332384609988, 8.841041422036149, 0.8842522430003296),
    "cm": (54.48615194189176, 60.118027045597366, 8.078677503112928),
    "cy": (18.82290502165302, 6.871425592049007, 30.89978309703729),
    "ck": (212.25662451639585, 31.159100130055922, -0.23883238689178934),
    "c": (-285.2331026137004, -79.2970844816548, -14.183576799673286),
    "mm": (1.7149763477362134, -15.310361306967817, 10.49593273432072),
    "my": (-5.6096736904047315, 17.575251261109482, 63.02378494754052),
    "mk": (-17.873870861415444, 131.35250912493976, 50.606957656360734),
    "m": (-5.497006427196366, -190.9453302588951, -112.23884253719248),
    "yy": (-2.5217340131683033, 4.444339102852739, 0.03296041114873217),
    "yk": (-21.248923337353073, 9.8632861493405, 115.60384449646641),
    "y": (17.5119270841813, -24.86741582555878, -193.58209356861505),
    "kk": (-21.86122147463605, -20.737325471181034, -22.33816807309886),
    "k": (-189.48180835922747, -187.80453709719578, -180.12613974708367),
}
#: Luminance weights; linear RGB from XYZ; the most that close colours differ by and that similar ones' chroma does.
LUMA = (0.299, 0.587, 0.114)
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
CLOSE, SIMILAR = 1.1e-07, 0.02
GAMMA = 1 / 2.2


def cmyk_to_rgb(c, m, y, k):
    """The plain formula."""
    return tuple(1 - F.least(F.lit(1.0), x + k) for x in (c, m, y))


def cmyk_to_rgb_polynomial(c, m, y, k):
    """The polynomial of second degree, cut to 0 to 1."""
    own = {"c": c, "m": m, "y": y, "k": k}
    term = lambda name: own[name] if len(name) == 1 else own[name[0]] * own[name[1]]
    sums = [sum((term(n) * v[i] for n, v in CMYK_POLYNOMIAL.items()), F.lit(0.0)) / 255 + 1 for i in range(3)]
    return tuple(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in sums)


def rgb_to_cmyk(r, g, b):
    """Black is what all three lack; full black has no colour."""
    black = 1 - F.greatest(r, g, b)
    rest = lambda x: F.when(black == 1.0, 0.0).otherwise((1 - x - black) / (1 - black))
    return rest(r), rest(g), rest(b), black


def rgb_to_gray(r, g, b):
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def rgb_to_ycc(r, g, b):
    return (r * 0.299 + g * 0.587 + b * 0.114, r * -0.168736 - g * 0.331264 + b * 0.5, r * 0.5 - g * 0.418688 - b * 0.081312)


def cal_gray(x, gamma: float):
    return F.pow(F.pow(x, F.lit(gamma)), F.lit(GAMMA))


def lab_to_rgb(lightness, a, b):
    """L from 0 to 100, a and b about -100 to 100, under the reference white; components are cut at 0 before their roots."""
    m = (lightness + 16) / 116
    cube = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))
    xyz = cube(m + a / 500), cube(m), cube(m - b / 200)
    return tuple(F.sqrt(F.greatest(F.lit(0.0), sum(x * w for x, w in zip(xyz, row, strict=True)) / sum(row))) for row in XYZ_TO_RGB)


def indexed(palette: list, index):
    """The palette's entry; an index beyond it is its nearest end."""
    return F.element_at(F.lit(palette), F.least(F.greatest(index, F.lit(0)), F.lit(len(palette) - 1)).cast("int") + 1)


def close(a, b):
    return (F.abs(a[0] - b[0]) < CLOSE) & (F.abs(a[1] - b[1]) < CLOSE) & (F.abs(a[2] - b[2]) < CLOSE)


def chroma_distance(a, b):
    (_, u, v), (_, s, t) = rgb_to_ycc(*a), rgb_to_ycc(*b)
    return F.sqrt((u - s) * (u - s) + (v - t) * (v - t))


def cal_rgb(a, b, c, gamma: tuple[float, ...], matrix: tuple[float, ...]):
    """Components through their gammas and a matrix, given by columns, to X, Y, Z, and from there to RGB as lab_to_rgb does."""
    own = [F.pow(x, F.lit(g)) for x, g in zip((a, b, c), gamma, strict=True)]
    xyz = [sum((own[k] * matrix[3 * k + i] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return tuple(F.sqrt(F.greatest(F.lit(0.0), sum(x * w for x, w in zip(xyz, row, strict=True)) / sum(row))) for row in XYZ_TO_RGB)


def decoded(sample, lo, hi, bits: int):
    """What a sample of `bits` bits stands for between two ends."""
    return lo + sample * (hi - lo) / ((1 << bits) - 1)
