"""Row-by-row fold of a change log in plain Python: the test oracle for the
closed-form replay (small inputs only)."""


def fold_reference(shelf_rows, record_rows, log_rows):
    """Row-by-row fold in plain Python (test oracle for small inputs).

    shelf_rows: dicts with user_id, b_isbn, b_page, b_end_yn, b_create_dt, b_update_dt
    record_rows: dicts with user_id, b_isbn, r_date, r_page
    log_rows: dicts with user_id, b_isbn, seq, op, r_date, r_page
    """
    shelf = [dict(s) for s in shelf_rows]  # a book may stand on a shelf several times
    recs = [dict(r) for r in record_rows]
    for e in sorted(log_rows, key=lambda x: (x["user_id"], x["seq"])):
        u = e["user_id"]
        if e["op"] == "add":
            recs.append({"user_id": u, "b_isbn": e["b_isbn"], "r_date": e["r_date"], "r_page": e["r_page"]})
        else:
            recs = [
                r for r in recs
                if not (r["user_id"] == u and r["b_isbn"] == e["b_isbn"] and r["r_date"] == e["r_date"])
            ]
        for s in shelf:
            if s["user_id"] != u:
                continue
            si = s["b_isbn"]
            mine = [r for r in recs if r["user_id"] == u and r["b_isbn"] == si]
            dated = [r["r_date"] for r in mine if r["r_date"] is not None]
            s["b_create_dt"] = min(dated) if dated else None
            s["b_update_dt"] = max(dated) if dated else None
            pages = [r["r_page"] for r in mine if r["r_page"] is not None]
            total = sum(pages) if pages else None
            if e["op"] == "add":
                if total is not None and s["b_page"] is not None and total == s["b_page"]:
                    s["b_end_yn"] = "Y"
            else:
                if not mine or (total is not None and s["b_page"] is not None and total != s["b_page"]):
                    s["b_end_yn"] = "N"
    return shelf, recs
