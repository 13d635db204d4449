"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

A text is normalised to its lower-case words. For each template all windows of the text's bigrams are looked at, wherever
they begin or end: within a line, over several, or amid a sentence. Two bags of bigrams of m and w elements reach the
coefficient s only if min(m, w) / max(m, w) >= s / (2 - s), so a window's size is bounded on both sides and templates
too large for the text drop out; and it must hold at least s / (2 - s) of the template's bigrams, so an index from bigram
to templates tells the places, mostly none, where that many stand close enough. Only there windows are counted out:
they begin and end with a bigram of the template, as any other would be better without its ends.

Of overlapping windows the best one stays; on ties the shorter one, then the earlier, then the first template. Windows
of one text that do not overlap are all reported.

Offsets count code points, ends are exclusive. A one-word text has no bigram and matches nothing, nor do null and
empty texts. Rows are independent; every row with a match is reported, once per match.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import documents, with_columns_from_text

DICE = 0.8

# Names of licenses and the notices by which they are granted.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]

_WORD = re.compile(r"[^\W_]+")


def lowered(text: str) -> str:
    """Lower case, character by character: offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def bigrams(text: str) -> list[tuple[str, str]]:
    words = _WORD.findall(lowered(text))
    return list(zip(words, words[1:]))


class Templates:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE):
        self.dice, self.ratio = dice, dice / (2 - dice)
        self.names = [name for name, _ in templates]
        self.bags = [Counter(bigrams(t)) for _, t in templates]
        self.sizes = [b.total() for b in self.bags]
        # Least number of a template's bigrams in a window, and the most bigrams that a window may have.
        self.least = [max(1, math.ceil(m * self.ratio - 1e-9)) for m in self.sizes]
        self.most = [math.floor(m / self.ratio + 1e-9) for m in self.sizes]
        self.holds: dict[tuple[str, str], list[int]] = {}
        for j, bag in enumerate(self.bags):
            for pair in bag:
                self.holds.setdefault(pair, []).append(j)

    def windows(self, pairs: list[tuple[str, str]]) -> Iterator[tuple[float, int, int, int]]:
        """(dice, first, last, template): for each template and first bigram the best window from there, if it reaches the
        least coefficient; the shorter one on ties."""
        known = list(map(self.holds.get, pairs))
        if not any(known):
            return
        places: dict[int, list[int]] = {}
        for at, held in enumerate(known):
            for j in held or ():
                places.setdefault(j, []).append(at)
        for j, at in places.items():
            least, most, m, bag = self.least[j], self.most[j], self.sizes[j], self.bags[j]
            for i in range(len(at) - least + 1):
                if at[i + least - 1] - at[i] >= most:
                    continue
                room, shared, best = dict(bag), 0, (0.0, 0)
                for k in range(i, len(at)):
                    size = at[k] - at[i] + 1
                    if size > most:
                        break
                    if room[pairs[at[k]]]:
                        room[pairs[at[k]]] -= 1
                        shared += 1
                        best = max(best, (2 * shared / (m + size), -at[k]))
                if best[0] >= self.dice - 1e-12:
                    yield best[0], at[i], -best[1], j

    def matches(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, license, dice) of the matching windows, none overlapping."""
        low = lowered(text)
        words = _WORD.findall(low)
        found = sorted(self.windows(list(zip(words, words[1:]))), key=lambda w: (-w[0], w[2] - w[1], w[1], w[3]))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        kept: list[tuple] = []
        for dice, first, last, j in found:
            one = (spans[first][0], spans[last + 1][1], self.names[j], dice)
            place = bisect_left(kept, one)  # kept ones do not overlap, so only the two neighbours matter
            if (not place or kept[place - 1][1] <= one[0]) and (place == len(kept) or one[1] <= kept[place][0]):
                insort(kept, one)
        return kept


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, span_start, span_end, license and dice of every match."""

    def make():
        found = Templates(templates, dice)
        return lambda text: ([dict(zip(("span_start", "span_end", "license", "dice"), m)) for m in found.matches(text)],)

    fields = "found array<struct<span_start: int, span_end: int, license: string, dice: double>>"
    return with_columns_from_text(docs, make, fields, ["doc_id"]).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
