"""Normal distribution functions as Column expressions.

Spark SQL has no error function or probit, so both are written as rational
approximations over Columns. They stay inside whole-stage code generation and
never leave the JVM.

Sources (published numerical methods): W. J. Cody, "Rational Chebyshev
approximation for the error function", Math. Comp. 23 (1969); M. J. Wichura,
algorithm AS 241, Appl. Statist. 37 (1988).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody 1969, |x| <= 0.46875 (numerator, denominator; highest power first)
_ERF_P = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
          3.77485237685302021e2, 3.20937758913846947e3]
_ERF_Q = [1.0, 2.36012909523441209e1, 2.44024637934444173e2,
          1.28261652607737228e3, 2.84423683343917062e3]
# Cody 1969, 0.46875 <= x <= 4
_MID_P = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
          6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
          1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_MID_Q = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
          1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
          3.43936767414372164e3, 1.23033935480374942e3]
# Cody 1969, x >= 4 (in powers of 1/x^2)
_FAR_P = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
          1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_FAR_Q = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
          6.05183413124413191e-2, 2.33520497626869185e-3]
# AS 241 (PPND16), central / intermediate / tail regions
_PPF_CENTRE_P = [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
                 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
                 1.3314166789178437745e2, 3.3871328727963666080e0]
_PPF_CENTRE_Q = [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
                 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
                 4.2313330701600911252e1, 1.0]
_PPF_MID_P = [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
              1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
              4.63033784615654529590e0, 1.42343711074968357734e0]
_PPF_MID_Q = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
              1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
              2.05319162663775882187e0, 1.0]
_PPF_TAIL_P = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
               2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
               5.46378491116411436990e0, 6.65790464350110377720e0]
_PPF_TAIL_Q = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
               7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
               5.99832206555887937690e-1, 1.0]


def _poly(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _erfc_positive(y: Column) -> Column:
    near = 1.0 - y * _poly(y * y, _ERF_P) / _poly(y * y, _ERF_Q)
    mid = F.exp(-y * y) * _poly(y, _MID_P) / _poly(y, _MID_Q)
    w = 1.0 / F.greatest(y * y, F.lit(1.0))  # keeps the unused branch finite at 0
    far = F.exp(-y * y) / F.greatest(y, F.lit(1.0)) * (
        F.lit(1.0 / math.sqrt(math.pi)) - w * _poly(w, _FAR_P) / _poly(w, _FAR_Q)
    )
    return F.when(y <= 0.46875, near).when(y <= 4.0, mid).when(y < 27.5, far).otherwise(0.0)


def erfc(x: Column) -> Column:
    """Complementary error function, accurate in the far tail.

    The expression refers to ``x`` many times: name a long input with
    ``withColumn`` first.
    """
    positive = _erfc_positive(F.abs(x))
    return F.when(x >= 0, positive).otherwise(2.0 - positive)


def norm_sf(z: Column) -> Column:
    """Upper tail probability of the standard normal."""
    return 0.5 * erfc(z / math.sqrt(2.0))


def norm_cdf(z: Column) -> Column:
    return norm_sf(-z)


def two_sided_p(z: Column) -> Column:
    """``P(|N(0,1)| >= |z|)``.

    Beyond 37 the density is divided by a continued fraction in the usual order:
    the result has few digits left there, so an order of its own would show.
    """
    a = F.abs(z)
    b = F.greatest(a, F.lit(37.0))  # keeps the unused branch finite at 0
    fraction = reduce(lambda acc, k: b + F.lit(float(k)) / acc, range(6, 0, -1), b)
    far = 2.0 * F.exp(-0.5 * z * z) / F.sqrt(2.0 * F.pi()) / fraction
    return F.when(a > 37.0, far).otherwise(_erfc_positive(a / math.sqrt(2.0)))


def norm_ppf(u: Column) -> Column:
    """Quantile function of the standard normal for ``0 < u < 1``."""
    q = u - 0.5
    r_centre = 0.180625 - q * q
    centre = q * _poly(r_centre, _PPF_CENTRE_P) / _poly(r_centre, _PPF_CENTRE_Q)
    r = F.sqrt(-F.log(F.when(q < 0, u).otherwise(1.0 - u)))
    mid = _poly(r - 1.6, _PPF_MID_P) / _poly(r - 1.6, _PPF_MID_Q)
    tail = _poly(r - 5.0, _PPF_TAIL_P) / _poly(r - 5.0, _PPF_TAIL_Q)
    outer = F.when(r <= 5.0, mid).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)
