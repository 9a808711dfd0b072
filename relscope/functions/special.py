"""Special functions as Catalyst expressions, and quantiles on the driver.

Spark has no gamma, beta or error functions.  Tails come from series and continued
fractions folded over a sequence, so p-values stay inside the plan, on result rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
TINY = 1e-300
STEPS = 300
#: From this parameter on the incomplete gamma function has its uniform expansion; below, ``STEPS`` terms are enough.
LARGE = 1000.0
#: The expansion's first two coefficients as series.
UNIFORM_0 = (-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515)
UNIFORM_1 = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760)


def _fold(start: Column, steps: int, f, finish) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, f, finish)


def bound(f, **values: Column) -> Column:
    """``f`` of values that are computed once, however often it uses them.

    A null gives null.  The optimizer copies a column's definition to each of its uses; a lambda's variable
    stays one, so plans, which the driver holds, stay small.
    """
    one = F.array(F.struct(*(v.cast("double").alias(k) for k, v in values.items())))

    def of(s: Column) -> Column:
        known = F.lit(True)
        for k in values:
            known = known & s[k].isNotNull()
        return F.when(known, f(*(s[k] for k in values)))

    return F.element_at(F.transform(one, of), 1)


def _guarded(v: Column) -> Column:
    return F.when(F.abs(v) < TINY, TINY).otherwise(v)


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def gamma_sf(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function.

    A series below a + 1, a continued fraction above; for large ``a``, where these need too many steps, the expansion
    that is uniform in x: half a complementary error function, which is the case a = 1/2, and a correction.
    """
    return bound(_gamma_sf_any, a=a, x=x)


def _gamma_sf_any(a: Column, x: Column) -> Column:
    large = (a > LARGE) & (x > 0)

    def series(coefficients: tuple[float, ...], near: Column) -> Column:
        out = F.lit(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = out * near + c
        return out

    def of_half(ratio: Column, half: Column) -> Column:
        tail = bound(_gamma_sf, a=F.when(large, 0.5).otherwise(a), x=F.when(large, a * half).otherwise(x))

        def finish(tail: Column, eta: Column) -> Column:
            near = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), eta))  # farther out the correction is nothing
            terms = bound(lambda near: series(UNIFORM_0, near) + series(UNIFORM_1, near) / a, near=near)
            uniform = F.when(eta >= 0, tail / 2).otherwise(1 - tail / 2) + F.exp(-a * half) / F.sqrt(2 * math.pi * a) * terms
            return F.when(large, F.greatest(F.lit(0.0), F.least(F.lit(1.0), uniform))).otherwise(tail)

        return bound(finish, tail=tail, eta=F.signum(ratio - 1) * F.sqrt(2 * half))

    # log1p keeps the difference exact near 1.
    of_ratio = lambda r: bound(of_half, ratio=r, half=F.greatest(F.lit(0.0), (r - 1) - F.log1p(r - 1)))
    return bound(of_ratio, ratio=F.when(large, x / a).otherwise(1.0))


def _gamma_sf(a: Column, x: Column) -> Column:
    series = _fold(
        F.struct((1 / a).alias("t"), (1 / a).alias("s")),
        STEPS,
        lambda s, n: F.struct((s.t * x / (a + n)).alias("t"), (s.s + s.t * x / (a + n)).alias("s")),
        lambda s: s.s,
    )

    def step(s: Column, n: Column) -> Column:
        an, b = -n * (n - a), s.b + 2
        return bound(lambda c, d: F.struct(b.alias("b"), c.alias("c"), (1 / d).alias("d"), (s.h * c / d).alias("h")), c=_guarded(b + an / s.c), d=_guarded(an * s.d + b))

    def fraction(b0: Column, d0: Column) -> Column:
        first = F.struct(b0.alias("b"), F.lit(1 / TINY).alias("c"), d0.alias("d"), d0.alias("h"))
        return _fold(first, STEPS, step, lambda s: s.h)

    b0 = x + 1 - a
    far = bound(fraction, b0=b0, d0=1 / F.when(b0 == 0, TINY).otherwise(b0))
    value = bound(lambda front: F.when(x < a + 1, 1 - front * series).otherwise(F.least(F.lit(1.0), front * far)), front=F.exp(a * F.log(x) - x - lgamma(a)))
    return F.when(x <= 0, 1.0).otherwise(value)


def beta_cdf(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, from the side where its continued fraction is fast."""
    return bound(_beta_cdf, a=a, b=b, x=x)


def _beta_cdf(a: Column, b: Column, x: Column) -> Column:
    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

            def second(c1: Column, d1: Column) -> Column:
                odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                both = lambda c2, d2: F.struct(c2.alias("c"), d2.alias("d"), (s.h * d1 * c1 * d2 * c2).alias("h"))
                return bound(lambda odd: bound(both, c2=_guarded(1 + odd / c1), d2=1 / _guarded(1 + odd * d1)), odd=odd)

            return bound(lambda even: bound(second, c1=_guarded(1 + even / s.c), d1=1 / _guarded(1 + even * s.d)), even=even)

        first = lambda d0: F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        return bound(lambda d0: _fold(first(d0), STEPS, step, lambda s: s.h), d0=1 / _guarded(1 - (a + b) * x / (a + 1)))

    def inner(y: Column) -> Column:
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(y) + b * F.log(1 - y))
        direct = y < (a + 1) / (a + b + 2)
        # One fraction, of the side that is fast.
        side = F.when(direct, F.struct(a.alias("a"), b.alias("b"), y.alias("x"))).otherwise(F.struct(b.alias("a"), a.alias("b"), (1 - y).alias("x")))
        part = F.element_at(F.transform(F.array(side), lambda s: fraction(s.a, s.b, s.x) / s.a), 1)
        return bound(lambda p: F.when(direct, p).otherwise(1 - p), p=front * part)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(bound(inner, y=x))


def chi2_sf(x: Column, dof: Column) -> Column:
    return F.when(dof > 0, gamma_sf(dof / 2, x / 2))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    return F.when((d1 > 0) & (d2 > 0) & (f >= 0), beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_sf2(t: Column, dof: Column) -> Column:
    """Both tails of Student's t distribution."""
    return F.when(dof > 0, beta_cdf(dof / 2, F.lit(0.5), dof / (dof + t * t)))


def erf(z: Column) -> Column:
    return F.signum(z) * (1 - gamma_sf(F.lit(0.5), z * z))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def kolmogorov_sf(x: Column) -> Column:
    """Asymptotic two-sided tail of the Kolmogorov-Smirnov statistic."""
    term = lambda s, k: s + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * x * x)
    return F.when(x < 0.05, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term))))


# On the driver: quantiles for a handful of confidence levels.


def _bisect(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return _bisect(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)) - p, -40.0, 40.0)


#: Wichura's rational approximations (algorithm AS 241), numerators and denominators from the constant up,
#: of q = p - 1/2 by 0.180625 - q^2, and of r = sqrt(-log(min(p, 1 - p))) by r - 1.6 while r is at most 5.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
OUTER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)


def polynomial(coefficients, x):
    """From the constant up."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile_of(p: Column) -> Column:
    """The normal quantile of a probability between 1e-11 and 1 - 1e-11, to double precision."""
    q = p - 0.5
    near = F.lit(0.180625) - q * q
    far = F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    outer = F.signum(q) * polynomial(OUTER[0], far) / polynomial(OUTER[1], far)
    return F.when(F.abs(q) <= 0.425, q * polynomial(MIDDLE[0], near) / polynomial(MIDDLE[1], near)).otherwise(outer)


def normal_sf(z: Column) -> Column:
    """The upper tail, right far out too."""
    return bound(lambda z: bound(lambda half: F.when(z > 0, half).otherwise(1 - half), half=chi2_sf(z * z, F.lit(1.0)) / 2), z=z)


def _t_cdf(t: float, dof: float) -> float:
    """By the beta function's continued fraction."""
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, STEPS):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
        return h

    if t == 0:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    both = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return 1 - both / 2 if t > 0 else both / 2


def t_quantile(p: float, dof: float) -> float:
    return _bisect(lambda t: _t_cdf(t, dof) - p, -1e6, 1e6)
