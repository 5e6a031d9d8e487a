"""Known statistics and sample sizes, and a plain model of the allocation rules."""

from math import floor, inf, isnan, nan, sqrt

# Published statistics of 15 strata (stratum, mean, deviation, rows)
# and the sizes worked out for a budget of 150 rows.
STRATA = [
    ("CL,co,µg/m³", 700.91, 0.0, 1, 1),
    ("CL,no2,µg/m³", 2.95, 0.0, 1, 1),
    ("CL,o3,µg/m³", 26.4, 0.0, 1, 1),
    ("CL,pm10,µg/m³", 23.47, 0.0, 1, 1),
    ("CL,pm25,µg/m³", 9.370000000000001, 8.541174782585044, 3, 3),
    ("CL,so2,µg/m³", 42.394, 70.4238094965048, 5, 5),
    ("CO,pm25,µg/m³", 27.0, 0.0, 1, 1),
    ("IN,co,µg/m³", 54010.98901098901, 24793.42987478585, 91, 18),
    ("IN,no2,µg/m³", 47.20289855072465, 30.77198976207493, 69, 23),
    ("IN,o3,µg/m³", 80.15384615384613, 66.71448482306596, 78, 27),
    ("IN,pm10,µg/m³", 138.25454545454545, 56.02052162355512, 55, 17),
    ("IN,pm25,µg/m³", 138.79104477611943, 72.0461165149003, 67, 19),
    ("IN,so2,µg/m³", 20.491803278688526, 20.792198214336345, 61, 31),
    ("LV,no2,µg/m³", 2.848877, 0.0, 1, 1),
    ("LV,o3,µg/m³", 97.429688, 0.0, 1, 1),
]

# Records of three strata that were sampled whole.
RECORDS = {
    ("CL", "so2", "µg/m³"): [6.0, 2.97, 183.0, 15.0, 5.0],
    ("CO", "pm25", "µg/m³"): [27.0],
    ("CL", "pm25", "µg/m³"): [2.62, 4.07, 21.42],
}


def ieee(a, b):
    if b != 0:
        return a / b
    if a == 0 or isnan(a):
        return nan
    return inf if a > 0 else -inf


def sizes(strata, budget, weights=None, cv="signed"):
    """Sample sizes by playing the rounds; strata are (key, mean, std, n)."""
    strata = sorted(strata)
    weights = weights or [1.0] * len(strata)
    gamma = [
        sqrt(w) * ieee(s, abs(m) if cv == "abs" else m) for (_, m, s, _), w in zip(strata, weights)
    ]
    total = sum(gamma)
    state = []
    for (key, _, _, n), g in zip(strata, gamma):
        ask = budget * ieee(g, total)
        want = 1.0 if ask < 1 else ask
        base = 0 if isnan(want) else n if want >= n else floor(want)
        rest = want - base
        state.append([(isnan(rest), 0.0 if isnan(rest) else rest, key), n, base])
    spare = budget - sum(x[2] for x in state)
    state.sort(key=lambda x: x[0], reverse=spare > 0)
    while spare:
        for x in state:
            if spare > 0 and x[2] < x[1]:
                x[2] += 1
                spare -= 1
            elif spare < 0 and x[2] > 1:
                x[2] -= 1
                spare += 1
            if not spare:
                break
    return {x[0][2]: x[2] for x in state}
