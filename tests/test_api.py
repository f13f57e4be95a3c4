"""Public entry points: batch export from a URL-list file."""

import glob
import json
import os
import tempfile


from webreach import api
from webreach.plans import site_queries as SQ

SF = "/root/testdata/sf0.001"


def test_batch_export_writes_records_in_input_order(spark):
    T = SQ.stages(spark, SF).tables
    d = tempfile.mkdtemp(prefix="webreach-api-", dir="/tmp")
    urls = os.path.join(d, "urls.txt")
    with open(urls, "w") as f:
        f.write("site10.test\nhttps://site11.test\nftp://nope\nhttps://site12.test\nsite10.test\n")
    recs = api.batch_export(urls, T["syn_pages"], out_json=os.path.join(d, "json"), out_csv=os.path.join(d, "csv"),
                            search_results=T["search_results"], ai_contacts=T["ai_contacts"],
                            ai_decisions=T["ai_decisions"])
    got = [r.website for r in recs.orderBy("input_pos").collect()]
    assert got == ["https://site10.test/", "https://site11.test", "https://site12.test/", "https://site10.test/"]
    lines = [json.loads(l) for p in sorted(glob.glob(os.path.join(d, "json", "part-*"))) for l in open(p)]
    assert [l["Website"] for l in lines] == got
    assert all(isinstance(l["Phone"], list) for l in lines)
    header = open(sorted(glob.glob(os.path.join(d, "csv", "part-*")))[0]).readline().strip()
    assert header == "Website,Email,Phone,AI Summary"
