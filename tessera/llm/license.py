"""Licence scans: a trained paragraph classifier, in DataFrame expressions only.

The paragraphs are lines, and as notices wrap, windows of neighbouring lines up to a blank one, long enough for every
template however it is wrapped. A logistic regression over their word n-grams (one and two words) names a licence family or
the unknown class, which also takes what is less probable than a calibrated threshold. A prediction counts if it is more
probable than a second, higher one, or if the paragraph holds half of the n-grams of one of the family's templates, which are
other texts than those the model is fitted to.

What is classified must hold a word of the gate, which follows from the model: n-grams of everyday words alone have no
weight, and without the gate's words all weights that are left cannot make any family probable enough.
"""

from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices of each family that a prediction is confirmed by; no model is fitted to them (fixed values).
TEMPLATES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3", "either version 3 of the gnu affero general public license or any later version", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license", "spdx-license-identifier apache-2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse", "licensed under the bsd 3-clause license"],
    "bsl-1.0": ["distributed under the boost software license version 1.0", "boost software license version 1.0"],
    "cc-by": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license", "this work is available under creative commons attribution"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license", "this work is licensed under cc by-nc-sa 4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license", "text is available under the creative commons attribution-sharealike license"],
    "cc0": ["licensed under cc0 1.0", "dedicated to the public domain under cc0", "no rights reserved cc0 1.0 universal public domain dedication"],
    "cddl-1.0": ["subject to the terms of the common development and distribution license"],
    "epl-2.0": ["made available under the terms of the eclipse public license", "licensed under the eclipse public license version 2.0", "spdx-license-identifier epl-2.0"],
    "eupl-1.2": ["licensed under the european union public licence", "licensed under the eupl version 1.2"],
    "gpl-2.0": ["licensed under the gnu general public license version 2", "gnu general public license as published by the free software foundation either version 2 of the license", "spdx-license-identifier gpl-2.0-only"],
    "gpl-3.0": ["licensed under the gnu general public license version 3", "gnu general public license as published by the free software foundation either version 3 of the license", "released under the gpl v3", "spdx-license-identifier gpl-3.0-or-later"],
    "isc": ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation", "released under the lgpl"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx-license-identifier mit"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
    "wtfpl": ["do what the fuck you want to public license"],
    "zlib": ["released under the zlib license", "this software is provided as-is without any express or implied warranty in no event will the authors be held liable"],
}
#: Other wordings of each family, which the model is fitted to (fixed values).
NOTICES = {
    "agpl-3.0": ["this program is available under the gnu affero general public license v3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "distributed under agpl-3.0", "the affero gpl applies to this server software", "see the gnu affero general public license for more details"],
    "apache-2.0": ["distributed under the terms of the apache license version 2.0", "available under the apache 2.0 license", "unless required by applicable law or agreed to in writing software distributed under the apache license is distributed on an as is basis", "apache software license 2.0", "obtain a copy of the apache license at apache.org licenses license-2.0", "not use this file except in compliance with the apache license version 2.0", "license apache-2.0"],
    "bsd": ["available under the new bsd license", "distributed under the 2-clause bsd license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice", "use of this source code is governed by a bsd-style license", "use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software", "spdx-license-identifier bsd-3-clause"],
    "bsl-1.0": ["use modification and distribution are subject to the boost software license version 1.0", "available under the boost software license", "spdx-license-identifier bsl-1.0"],
    "cc-by": ["released under a creative commons attribution license", "made available under cc by 3.0", "this article is distributed under the creative commons attribution 4.0 license", "content under cc-by 4.0", "available under a creative commons attribution 3.0 unported license", "licensed under cc by 3.0", "license cc by 4.0"],
    "cc-by-nc": ["released under a creative commons attribution-noncommercial license", "made available under cc by-nc 3.0", "distributed under the creative commons attribution-noncommercial-noderivatives license", "content under cc by-nc-nd 4.0", "shared under cc by-nc-sa 3.0", "licensed under cc by-nc 3.0", "under a creative commons attribution-noncommercial 4.0 license"],
    "cc-by-sa": ["released under a creative commons attribution-sharealike license", "made available under cc by-sa 3.0", "distributed under the creative commons attribution-sharealike 4.0 license", "content under cc by-sa 4.0", "licensed under cc by-sa 3.0"],
    "cc0": ["released into the public domain with cc0", "made available under the cc0 1.0 universal dedication", "to the extent possible under law the author has waived all rights with cc0", "cc0 public domain dedication", "spdx-license-identifier cc0-1.0", "under cc0 1.0"],
    "cddl-1.0": ["distributed under the common development and distribution license cddl 1.0", "the contents of this file are subject to the terms of the common development and distribution license", "spdx-license-identifier cddl-1.0"],
    "epl-2.0": ["this program and the accompanying materials are made available under the eclipse public license v2.0", "distributed under the eclipse public license 2.0", "which is available at eclipse.org legal epl-2.0", "released under the eclipse public license", "eclipse public license v 2.0 applies", "license epl-2.0"],
    "eupl-1.2": ["distributed under the eupl", "released under the european union public licence v 1.2", "spdx-license-identifier eupl-1.2", "the european union public licence applies to this work"],
    "gpl-2.0": ["released under the gpl v2", "distributed under the gnu general public license version 2 only", "modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "available under gplv2", "spdx-license-identifier gpl-2.0", "gnu general public license v2", "license gpl-2.0-or-later", "licensed under the gnu general public license version 2 or later"],
    "gpl-3.0": ["distributed under the gnu general public license version 3 or later", "modify it under the terms of the gnu general public license version 3 as published by the free software foundation", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "available under gplv3", "spdx-license-identifier gpl-3.0-only", "gnu general public license v3", "licensed under gpl-3.0", "gnu gpl version 3", "licensed under the gnu general public license version 3 or later"],
    "isc": ["available under the isc license", "licensed isc", "distributed under the terms of the isc license", "permission to use copy modify and distribute this software for any purpose with or without fee is granted", "spdx-license-identifier isc"],
    "lgpl": ["distributed under the gnu lesser general public license version 2.1 or later", "this library is free software under the gnu lesser general public license", "available under lgpl-3.0", "gnu lesser general public license v3", "modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license", "spdx-license-identifier lgpl-2.1-or-later", "licensed under the lgpl version 3", "gnu library general public license"],
    "mit": ["available under the mit license", "distributed under the terms of the mit license", "mit licensed", "free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is granted free of charge to any person", "the mit license mit", "see mit license in the license file", "code is mit licensed", "identifier mit license", "spdx-license-identifier mit expat"],
    "mpl-2.0": ["distributed under the mozilla public license version 2.0", "subject to the terms of the mozilla public license", "a copy of the mpl was not distributed with this file", "available under mpl 2.0", "spdx-license-identifier mpl-2.0", "source code form is subject to the mozilla public license v 2.0"],
    "unlicense": ["dedicated to the public domain by the unlicense", "available under the unlicense", "free and unencumbered software in the public domain", "spdx-license-identifier unlicense", "anyone is free to copy modify publish use compile sell or distribute this unencumbered software"],
    "wtfpl": ["released under the wtfpl", "do what the fuck you want to license", "wtfpl version 2"],
    "zlib": ["distributed under the zlib license", "available under the zlib libpng license", "provided as-is without any express or implied warranty", "in no event will the authors be held liable for any damages arising from the use of this software", "spdx-license-identifier zlib"],
}
#: Names of the families, and what they are put into beside NOTICES, in other words than the templates' (fixed values).
NAMES = {
    "agpl-3.0": ["the gnu affero general public license version 3", "agpl-3.0", "the gnu affero gpl version 3"], "apache-2.0": ["the apache license version 2.0", "apache-2.0"], "bsd": ["the bsd license", "the bsd 3-clause license", "bsd-2-clause", "a bsd-style license"],
    "bsl-1.0": ["the boost software license version 1.0", "bsl-1.0"], "cc-by": ["cc by 4.0", "creative commons attribution 4.0 international"], "cc-by-nc": ["cc by-nc 4.0", "cc by-nc-sa 4.0", "creative commons attribution-noncommercial 4.0 international"],
    "cc-by-sa": ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international"], "cc0": ["cc0 1.0 universal", "cc0"], "cddl-1.0": ["the cddl", "cddl-1.0"], "epl-2.0": ["the eclipse public license version 2.0", "epl-2.0"],
    "eupl-1.2": ["the european union public licence", "eupl-1.2", "the eupl"], "gpl-2.0": ["the gnu general public license version 2", "gpl-2.0-only", "the gpl v2", "the gplv2", "the gnu gpl version 2"], "gpl-3.0": ["the gnu general public license version 3", "gpl-3.0-or-later", "the gpl v3", "the gplv3", "the gnu gpl version 3"],
    "isc": ["the isc license", "isc"], "lgpl": ["the gnu lesser general public license", "the lgpl", "lgpl-2.1-only", "lgpl-2.1", "lgpl-3.0"], "mit": ["the mit license", "mit license", "the mit licence"], "mpl-2.0": ["the mozilla public license version 2.0", "mpl-2.0"],
    "unlicense": ["the unlicense"], "wtfpl": ["the wtfpl"], "zlib": ["the zlib license", "zlib"],
}
FRAMES = ("available under {}", "licensed {}", "{} licensed code", "the license is {}", "our code uses {}", "{}", "see {} for details", "terms of {}", "distributed under the terms of {}", "this project uses {}", "all files are covered by {}", "use is governed by {}", "spdx {}", "you get it under {}")
#: Paragraphs that hold a cue and no licence.
OTHERS = [
    "the mit students won a prize", "a team of the mit lab", "the mit museum is near the river", "he came to the mit library", "she studied physics at mit", "mit professors met the press", "the lab is at mit in the city", "members of the european union met", "the european union is a union of states", "the public was told of the terms", "a common source of error in development", "the source code is shown in the appendix", "free copies of the software are sent to any person", "the general version of the form",
    "he lost his driving licence last year", "the licence fee was raised by the board", "copyright 2021 all rights reserved", "permission denied while opening the file",
    "researchers at mit released a paper", "the apache helicopter landed in the field", "a licensed plumber came to the house", "this page is under construction version 2.0",
    "the warranty does not cover the screen", "ask for permission to use the hall", "the public library is free", "mozilla announced a new browser version", "the software is released every month",
    "the license of the restaurant has expired", "general public attended the open day", "terms and conditions apply to this offer", "licensed under the counter", "use of this form is subject to the terms",
    "commons debate on the creative industries", "no copyright infringement intended", "cc by mail to the office", "license plate number of the car", "copy of the permission slip", "redistribution of wealth in the country", "the eclipse was seen by the public", "a licence to sell wine was granted free of charge to the owner", "released under embargo until noon", "the boost in sales of the software", "the union published its terms",
    "the mit campus is open to the public", "version 3 of the plan was released under pressure", "the contents of this file are secret", "he was released without any charge", "the authors will be held to their word", "distributed under the door of each house",
    "permission is granted by the parents", "the gnu lives in the south", "a fishing license is available at the office", "no rights are reserved for members", "the public domain of the king", "attribution of the painting to the master", "subject to the terms of the lease",
]
#: Of these some are for fitting, the rest for calibration; everyday words, whose n-grams alone tell nothing (fixed values).
UNKNOWN, FITTED = "unknown", 42
EVERYDAY = frozenset("the of and a to in for under is are this any with or without from not use used uses be by it its may no all you your our we he she they will into do what want as at on if that which who was were has have had been more most other new only must can get see made make work page site data list name names file files time year people day way part place case following above below about after before between during out up down over again then there here when where how why each both few some such own same so than too very one two said says also".split())
FILLED = r"[\p{L}\p{N}]"
WORD = r"[^a-z0-9.+-]+"
#: Precision, on the templates, that the probabilities are calibrated to with a template and without; the least share of a
#: template's n-grams that confirms; steps, decay and least weight of the fit; buckets that n-grams are looked up in.
PRECISION, ALONE, CONTAINED, ROUNDS, DECAY, LEAST_WEIGHT, BUCKETS = 0.98, 0.995, 0.5, 160, 1e-4, 3e-5, 256


def grams(text: str) -> list[str]:
    """The distinct word n-grams of a text; dots at the end of a word are dropped."""
    words = [w for w in (re.sub(r"[.-]+$", "", w) for w in re.split(WORD, text.lower())) if w]
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def grams_of(text: Column) -> Column:
    """The same as an expression."""
    words = F.filter(F.transform(F.split(F.lower(text), WORD), lambda w: F.regexp_replace(w, r"[.-]+$", "")), lambda w: w != "")
    return F.element_at(F.transform(F.array(words), lambda w: F.array_compact(F.array_distinct(F.concat(w, F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))))), 1)


def _examples(notices: dict[str, list[str]], others: list[str], seed: int) -> tuple[list[str], list[str]]:
    """Paragraphs made from notices by a fixed seed: words put around, some dropped, and prose without licence."""
    rng = random.Random(seed)
    fill = "the of file and this code data page site see project work version our in for more details 2.0 3 4.0 1.0 software".split()
    texts, labels = [], []
    for label, lines in [*notices.items(), (UNKNOWN, others)]:
        for k in range(4 * len(lines) if label != UNKNOWN else 900):
            words = lines[k % len(lines)].split() if label != UNKNOWN or k % 4 else [rng.choice(fill) for _ in range(rng.randint(3, 25))]
            if rng.random() < 0.3 and len(words) > 6:
                words.pop(rng.randrange(len(words)) if label == UNKNOWN else rng.choice([0, len(words) - 4]))
            around = [[rng.choice(fill[:19]) for _ in range(rng.choice([0, 0, 2, 6]))] for _ in range(2)]
            texts.append(" ".join(around[0] + words + around[1]))
            labels.append(label)
    return texts, labels


class Model:
    """Classes, bias, weights of each n-gram and the least probability of a family. Fitted to NOTICES; the least
    probabilities are calibrated on examples made from TEMPLATES and from other prose, which the fit never saw."""

    def __init__(self) -> None:
        fitted = {f: own + [frame.format(name) for name in NAMES[f] for frame in FRAMES] for f, own in NOTICES.items()}
        texts, labels = _examples(fitted, OTHERS[:FITTED], 5)
        self.classes = [*TEMPLATES, UNKNOWN]
        seen: dict[str, int] = {}
        for t in texts:
            for g in grams(t):
                seen[g] = seen.get(g, 0) + 1
        place = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n > 2 and not set(g.split(" ")) <= EVERYDAY))}

        # Examples hold few of the n-grams: each is a run of places, and each place a run of examples.
        runs = [[place[g] for g in grams(t) if g in place] or [len(place)] for t in texts]
        at, of = np.concatenate(runs), np.repeat(np.arange(len(texts)), [len(r) for r in runs])
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        begins = np.cumsum([0] + [len(r) for r in runs[:-1]])
        w, b = np.zeros((len(place) + 1, len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        dw, db = np.zeros_like(w), np.zeros_like(b)
        target = np.eye(len(self.classes), dtype=np.float32)[[self.classes.index(c) for c in labels]]
        for _ in range(ROUNDS):  # accelerated, and small weights shrink to none
            ahead, bias = w + 0.9 * dw, b + 0.9 * db
            d = (self.soft(np.add.reduceat(ahead[at], begins) + bias) - target) / len(texts)
            new = ahead * (1 - 2 * DECAY)
            new[held] -= 2 * np.add.reduceat(d[of[order]], first)
            new = np.sign(new) * np.maximum(np.abs(new) - 2 * LEAST_WEIGHT, 0)
            new[-1] = 0
            dw, w = new - w, new
            db = bias - 2 * d.sum(0) - b
            b = b + db
        self.bias = [round(float(v), 4) for v in b]
        self.weights = {g: [round(float(v), 3) for v in w[k]] for g, k in place.items() if np.abs(w[k]).max() > 0.05}
        texts, labels = _examples(TEMPLATES, OTHERS[FITTED:], 6)
        y = np.array([self.classes.index(c) for c in labels])
        p = self.soft(np.stack([self.score(t) for t in texts]))
        best, top = p.argmax(1), p.max(1)
        order = np.argsort(-top)
        order = order[best[order] != len(self.classes) - 1]
        right = np.cumsum(best[order] == y[order]) / np.arange(1, len(order) + 1)

        def calibrated(precision: float, floor: float) -> float:
            good = np.flatnonzero(right >= precision)
            return round(max(floor, float(top[order[good[-1]]])), 6) if len(good) else 1.0

        #: Least probability of a family that a template confirms, and of one that counts alone.
        self.least, self.alone = calibrated(PRECISION, 0.4), calibrated(ALONE, 0.6)
        #: Of the calibration examples of a family, the share that is named rightly at the least probability.
        self.recall = float(((best == y) & (top >= self.least))[y != len(self.classes) - 1].mean())
        self.gate = self._gate()
        #: The gate as a pattern over lower-cased text: sound, as a word of it stands free of letters and digits wherever it is one.
        self.cues = "(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in self.gate) + ")(?![a-z0-9])"

    def score(self, text: str) -> np.ndarray:
        return np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(text) if g in self.weights), np.zeros(len(self.bias)))

    def reach(self, gone: set[str]) -> np.ndarray:
        """For each family, the most by which texts without some words can favour it over the unknown class."""
        left = [np.array(w) for g, w in self.weights.items() if not set(g.split(" ")) & gone]
        b = np.array(self.bias)
        return (b - b[-1] + sum((np.maximum(0, w - w[-1]) for w in left), np.zeros(len(b))))[:-1]

    def _gate(self) -> list[str]:
        """Words without which no family can reach the least probability: those of most weight first, until that holds."""
        enough = np.log(self.least / (1 - self.least)) - 0.01
        words: dict[str, float] = {}
        for g, w in self.weights.items():
            for v in set(g.split(" ")) - EVERYDAY:
                words[v] = max(words.get(v, 0.0), float(max(w[:-1]) - w[-1]))
        out: set[str] = set()
        for v in sorted(words, key=lambda v: (-words[v], v)):
            over = self.reach(out) > enough
            if not over.any():
                break
            if (self.reach(out | {v})[over] < self.reach(out)[over]).any():
                out.add(v)
        return sorted(out)

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def classify(self, text: str) -> tuple[str, float, bool]:
        """The plain version: family or unknown, its probability, and whether that or a template confirms it."""
        p = self.soft(self.score(text)[None])[0]
        k = int(p.argmax())
        family = self.classes[k] if p[k] >= self.least else UNKNOWN
        own = set(grams(text))
        held = max((len(own & set(t["grams"])) / len(t["grams"]) for t in _forms() if t["family"] == family and (not t["own"] or own & set(t["own"]))), default=0.0)
        return family, float(p[k]), family != UNKNOWN and (held >= CONTAINED or float(p[k]) >= self.alone)


_MODELS: list[Model] = []


def model() -> Model:
    if not _MODELS:
        _MODELS.append(Model())
    return _MODELS[0]


def _forms() -> list[dict]:
    """The templates as n-grams, and those of them (own) that no template of another family holds."""
    held = {f: {g for t in lines for g in grams(t)} for f, lines in TEMPLATES.items()}
    return [{"family": f, "grams": grams(t), "own": [g for g in grams(t) if not any(g in held[o] for o in held if o != f)]} for f, lines in TEMPLATES.items() for t in lines]


def scan(docs: DataFrame, text: str = "text", column: str = "paragraphs") -> DataFrame:
    """docs with the array `column` of struct(line, family, probability, confirmed) for each line that holds a word of the
    gate, and each confirmed notice that is wrapped over lines; confirmed: by the probability alone or by a template.

    line counts from 0, and is a wrapped notice's first. Null, empty and other texts without such words have an empty array;
    every line of a text is looked at, whatever its length; repeated lines and rows count each; an empty table gives no rows. Of confirmed lines and windows that overlap,
    the one stays confirmed that holds most of its template, then the one of fewest lines; a template with n-grams of
    its own confirms only what holds one of these. A column of that name is replaced.
    """
    m = model()
    table = [[{"g": g, "w": w} for g, w in m.weights.items() if zlib.crc32(g.encode()) % BUCKETS == k] for k in range(BUCKETS)]
    buckets = F.from_json(F.lit(json.dumps({"b": table})), "struct<b:array<array<struct<g:string,w:array<double>>>>>")["b"]
    templates = F.from_json(F.lit(json.dumps(_forms())), "array<struct<family:string,grams:array<string>,own:array<string>>>")
    classes = F.array(*map(F.lit, m.classes))
    most = max(len(t.split()) for lines in TEMPLATES.values() for t in lines)
    holds = lambda t: F.lower(t).rlike(m.cues)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def judged(c: Column) -> Column:
        """(line, last, family, probability, held) of (line, last, text); held is the most of a template, if of its own n-grams one is there."""

        def by_grams(c: Column) -> Column:
            entry = lambda g: F.filter(F.element_at(buckets, (F.crc32(F.encode(g, "utf-8")) % BUCKETS + 1).cast("int")), lambda e: e["g"] == g)
            z = F.aggregate(F.flatten(F.transform(c["grams"], entry)), F.array(*map(F.lit, m.bias)), lambda acc, e: F.zip_with(acc, e["w"], lambda a, b: a + b))

            def by_score(s: Column) -> Column:
                top = F.array_max(s)
                p = 1 / F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
                family = F.when(p >= m.least, F.element_at(classes, F.array_position(s, top).cast("int"))).otherwise(UNKNOWN)
                return F.struct(c["line"].alias("line"), c["last"].alias("last"), c["grams"].alias("grams"), family.alias("family"), p.alias("probability"))

            return let(z, by_score)

        def confirmed(c: Column) -> Column:
            fit = F.filter(templates, lambda t: (t["family"] == c["family"]) & ((F.size(t["own"]) == 0) | F.arrays_overlap(t["own"], c["grams"])))
            held = F.array_max(F.transform(fit, lambda t: F.size(F.array_intersect(t["grams"], c["grams"])) / F.size(t["grams"])))
            return F.struct(c["line"].alias("line"), c["last"].alias("last"), c["family"].alias("family"), c["probability"].alias("probability"), F.coalesce(held, F.lit(0.0)).alias("held"))

        return let(let(F.struct(c["line"].alias("line"), c["last"].alias("last"), grams_of(c["text"]).alias("grams")), by_grams), confirmed)

    def windows(lines: Column) -> Column:
        """(line, last, text) of each line with the next, the next two and so on, until these have as many words as a template."""
        begin = lambda t: F.struct(t.alias("text"), F.lit(0).alias("n"), t.rlike(FILLED).alias("open"), F.array().cast("array<string>").alias("made"))

        def step(acc: Column, x: Column) -> Column:
            both, n = F.concat(acc["text"], F.lit(" "), x), acc["n"] + F.size(F.split(x, r"\s+"))
            more = F.struct(both.alias("text"), n.alias("n"), (n < most + 2).alias("open"), F.concat(acc["made"], F.array(both)).alias("made"))
            end = F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(False).alias("open"), acc["made"].alias("made"))
            return F.when(acc["open"] & x.rlike(FILLED), more).otherwise(end)

        def of(t: Column, k: Column) -> Column:
            made = F.aggregate(F.slice(lines, k + 2, F.lit(most + 2)), begin(t), step, lambda acc: acc["made"])
            return F.filter(F.transform(made, lambda w, j: F.struct(k.alias("line"), (k + j + 1).alias("last"), w.alias("text"))), lambda w: holds(w["text"]))

        return F.flatten(F.transform(lines, of))

    overlap = lambda a, b: (a["line"] <= b["last"]) & (b["line"] <= a["last"])
    sure = lambda c: (c["family"] != UNKNOWN) & ((c["held"] >= CONTAINED) | (c["probability"] >= m.alone))
    told = lambda c, yes: F.struct(c["line"].alias("line"), c["family"].alias("family"), c["probability"].alias("probability"), yes.alias("confirmed"))

    def chosen(both: Column) -> Column:
        """The lines, and the windows that stay, of (lines, wins): judged lines and confirmed windows."""
        ranks = F.array_sort(F.transform(F.concat(F.filter(both["lines"], sure), both["wins"]), lambda c: F.struct((-c["held"]).alias("rank"), (c["last"] - c["line"]).alias("more"), c["line"].alias("at"), c.alias("c"))))
        first = F.filter(both["lines"], lambda c: F.lit(False))
        best = F.aggregate(ranks, first, lambda acc, r: F.when(F.exists(acc, lambda a: overlap(a, r["c"])), acc).otherwise(F.concat(acc, F.array(r["c"]))))
        def out(stay: Column) -> Column:
            lines = F.transform(both["lines"], lambda c: told(c, F.exists(stay, lambda s: (s["line"] == c["line"]) & (s["last"] == c["line"]))))
            wins = F.transform(F.filter(stay, lambda s: s["last"] > s["line"]), lambda s: told(s, F.lit(True)))
            return F.array_sort(F.concat(lines, wins))

        return let(best, out)

    def paragraphs(lines: Column) -> Column:
        alone = F.filter(F.transform(lines, lambda t, k: F.struct(k.alias("line"), k.alias("last"), t.alias("text"))), lambda c: holds(c["text"]))
        wins = F.filter(F.transform(windows(lines), judged), sure)
        return let(F.struct(F.transform(alone, judged).alias("lines"), wins.alias("wins")), chosen)

    found = F.when(holds(F.col(text)), let(F.split(F.col(text), "\n"), paragraphs))
    none = F.array().cast("array<struct<line:int,family:string,probability:double,confirmed:boolean>>")
    return docs.withColumn(column, F.coalesce(found, none))
