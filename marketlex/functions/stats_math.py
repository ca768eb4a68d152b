"""Closed-form distribution tails and small dense solves, vectorised with
numpy.  Used inside Arrow-batched tasks on tables that hold one row per
fitted group (sufficient statistics), never on raw rows."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_EPS = 1e-15
_TINY = 1e-300


def _betacf(a, b, x, iters=400):
    """Continued fraction of the incomplete beta (modified Lentz)."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        de = d * c
        h = h * de
        if np.all(np.abs(de - 1.0) < _EPS):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), elementwise."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        aa, bb, xx = a[mid], b[mid], x[mid]
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx))
        direct = xx < (aa + 1.0) / (aa + bb + 2.0)
        res = np.empty_like(xx)
        if direct.any():
            res[direct] = front[direct] * _betacf(aa[direct], bb[direct], xx[direct]) / aa[direct]
        if (~direct).any():
            r = ~direct
            res[r] = 1.0 - front[r] * _betacf(bb[r], aa[r], 1.0 - xx[r]) / bb[r]
        out[mid] = res
    return out


def f_sf(f, d1, d2):
    """Survival function of the F distribution."""
    f, d1, d2 = np.broadcast_arrays(np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float))
    out = betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.where(f > 0, f, 0.0)))
    return np.where(np.isnan(f), np.nan, out)


def t_sf_two_sided(t, nu):
    """P(|T| > |t|) for Student's t with ``nu`` degrees of freedom."""
    t, nu = np.broadcast_arrays(np.asarray(t, float), np.asarray(nu, float))
    return betainc(nu / 2.0, 0.5, nu / (nu + t * t))


def gammaincc(a, x, iters=500):
    """Regularised upper incomplete gamma Q(a, x), elementwise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0)
    out[ok & (x <= 0)] = 1.0
    ser = ok & (x > 0) & (x < a + 1.0)
    if ser.any():
        aa, xx = a[ser], x[ser]
        ap, s, dl = aa.copy(), 1.0 / aa, 1.0 / aa
        for _ in range(iters):
            ap = ap + 1.0
            dl = dl * xx / ap
            s = s + dl
            if np.all(np.abs(dl) < np.abs(s) * _EPS):
                break
        out[ser] = 1.0 - s * np.exp(-xx + aa * np.log(xx) - _lgamma(aa))
    cf = ok & (x >= a + 1.0)
    if cf.any():
        aa, xx = a[cf], x[cf]
        b = xx + 1.0 - aa
        c = np.full_like(xx, 1.0 / _TINY)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, iters + 1):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            de = d * c
            h = h * de
            if np.all(np.abs(de - 1.0) < _EPS):
                break
        out[cf] = np.exp(-xx + aa * np.log(xx) - _lgamma(aa)) * h
    return out


def chi2_sf(x, k):
    return gammaincc(np.asarray(k, float) / 2.0, np.asarray(x, float) / 2.0)


def normaltest_k2(skew, kurt_excess, n):
    """D'Agostino-Pearson K^2 from population skewness / excess kurtosis;
    returns (K2, p) with p = chi2_sf(K2, 2) = exp(-K2 / 2)."""
    g1 = np.asarray(skew, float)
    b2 = np.asarray(kurt_excess, float) + 3.0
    n = np.asarray(n, float)
    with np.errstate(all="ignore"):
        y = g1 * np.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
        beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + np.sqrt(2 * (beta2 - 1))
        delta = 1 / np.sqrt(0.5 * np.log(w2))
        alpha = np.sqrt(2.0 / (w2 - 1))
        z1 = delta * np.arcsinh(y / alpha)
        e = 3.0 * (n - 1) / (n + 1)
        var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
        x = (b2 - e) / np.sqrt(var)
        sqrtbeta1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * np.sqrt(
            6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6.0 + 8.0 / sqrtbeta1 * (2.0 / sqrtbeta1 + np.sqrt(1 + 4.0 / sqrtbeta1 ** 2))
        term1 = 1 - 2 / (9.0 * a)
        denom = 1 + x * np.sqrt(2 / (a - 4.0))
        term2 = np.cbrt((1 - 2.0 / a) / denom)
        z2 = (term1 - term2) / np.sqrt(2 / (9.0 * a))
        k2 = z1 * z1 + z2 * z2
    return k2, np.exp(-k2 / 2.0)


def ols_from_moments(n, mu, cov, y_idx, x_idx):
    """OLS with intercept from group moments (population covariance of the
    complete rows).  Pseudo-inverse, as a rank-deficient design still fits.
    Returns dict with coef, intercept, ssr, r2, se, intercept_se, df_resid."""
    x_idx = list(x_idx)
    k = len(x_idx)
    syy = n * cov[y_idx, y_idx]
    if k == 0:
        ssr = max(syy, 0.0)
        return dict(coef=np.zeros(0), intercept=mu[y_idx], ssr=ssr, r2=0.0,
                    se=np.zeros(0), intercept_se=math.sqrt(ssr / max(n - 1, 1) / n) if n > 1 else float("nan"),
                    df_resid=n - 1, rank=0)
    sxx = n * cov[np.ix_(x_idx, x_idx)]
    sxy = n * cov[x_idx, y_idx]
    pinv = np.linalg.pinv(sxx)
    beta = pinv @ sxy
    ssr = float(syy - sxy @ beta)
    ssr = max(ssr, 0.0)
    rank = int(np.linalg.matrix_rank(sxx)) if k else 0
    df_resid = n - rank - 1
    r2 = 1.0 - ssr / syy if syy > 0 else float("nan")
    s2 = ssr / df_resid if df_resid > 0 else float("nan")
    se = np.sqrt(np.clip(np.diag(pinv) * s2, 0, None))
    xbar = mu[x_idx]
    icpt = mu[y_idx] - xbar @ beta
    ise = math.sqrt(max(s2 * (1.0 / n + xbar @ pinv @ xbar), 0.0)) if df_resid > 0 else float("nan")
    return dict(coef=beta, intercept=float(icpt), ssr=ssr, r2=r2, se=se, intercept_se=ise,
                df_resid=df_resid, rank=rank)


def sym_from_upper(vals, k):
    """Full k x k matrix from the row-major upper triangle (i <= j)."""
    m = np.empty((k, k))
    it = iter(vals)
    for i in range(k):
        for j in range(i, k):
            v = next(it)
            m[i, j] = m[j, i] = np.nan if v is None else v
    return m
