"""What a page or a URL costs: parts are bound once, passes over text that can't match are short."""

import re

from pyspark.sql import functions as F

from leadlake.functions import contacts as C
from leadlake.functions import html as H
from leadlake.functions import urls as U


def test_url_parts_are_extracted_once(spark):
    assert str(U.parse_url_parts(F.col("u"))).count("regexp_extract(") <= 6
    links = str(H.extract_links(F.col("html"), U.parse_url_parts(F.col("u"))))
    assert links.count("regexp_extract_all(") == 1


def test_whitespace_runs_become_one_space(spark):
    texts = ["a b", "a  b", " a\tb ", "a \n b", " a　 b  ", "  ", "", "a b ﻿c", "a b  c\t\td  ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, html string").select("k", H.html_to_text(F.col("html")).alias("t")).collect()
    space = "[\t-\r    -     　﻿]+"
    assert {r.k: r.t for r in rows} == {k: None if t is None else re.sub(space, " ", t).strip(" ") for k, t in enumerate(texts)}


def test_emails_of_texts_with_and_without_at(spark):
    texts = [None, "", "no mail", "@", "x a.b@c.de, a.b@c.de y@z", "o'k@a-b.com"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", C.extract_emails(F.col("t")).alias("e")).orderBy("k").collect()
    assert [r.e for r in rows] == [[], [], [], [], ["a.b@c.de"], ["o'k@a-b.com"]]
