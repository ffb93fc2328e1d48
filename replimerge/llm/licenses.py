"""License scans (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .containment import containment_sql, find_contained, overlapping_classes

#: Notices in common use, by SPDX identifier. The sentence that two- and three-clause
#: BSD share stands for the first; the third clause tells the second. Bodies of licences are not listed.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = [(i, lic, text) for i, (lic, text) in enumerate(TEMPLATES if templates is None else templates)]
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def scan_licenses(docs: DataFrame, templates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, template_id, license, containment, first_shingle``: templates found in documents.

    Overlapping windows of a document retrieve templates by MinHash bands; each retrieved place is
    verified by exact shingle containment (see :func:`.containment.find_contained`, which also says
    how nulls, short texts, ties, repeats and empty tables come out). ``templates`` has
    ``template_id, license, text``.
    """
    found = find_contained(docs.select("doc_id", "text"), templates.select("template_id", "text"), overlapping_classes(), item="template_id", threshold=threshold)
    return found.join(templates.select("template_id", "license"), "template_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), template_table(spark))
    return found.select("doc_id", "template_id", "license", "containment")


_VALUES = ", ".join("({}, '{}', '{}')".format(i, lic, text.replace("'", "''")) for i, (lic, text) in enumerate(TEMPLATES))
SQL = f"""
SELECT f.doc_id, CAST(f.template_id AS INTEGER) AS template_id, license, containment
FROM ({containment_sql(f"SELECT * FROM (VALUES {_VALUES}) AS v(template_id, license, text)", "template_id")}) f
JOIN (VALUES {_VALUES}) AS v(template_id, license, text) ON v.template_id = f.template_id
"""
