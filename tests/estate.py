"""An invented estate shaped like real extracts, written as CSV files."""

import csv

FOLDERS = (
    "folder_id,sched_table,data_center,user_daily,table_status,table_type,instance_name,"
    "last_updated,last_updated_user,capture_date"
)
JOBS = (
    "job_id,version_serial,folder_id,job_name,parent_table,application,group_name,task_type,"
    "cyclic,cyclic_type,job_order,owner,author,node_id,cmd_line,description,memname,priority,"
    "critical,active_from,active_till,end_folder,is_current_version,version_opcode,"
    "version_timestamp,version_user,instance_name,capture_date"
)
CONDITIONS_IN = (
    "folder_id,job_id,version_serial,condition_name,odate,and_or,parentheses,order_,isn,"
    "version_opcode,is_current_version,capture_date"
)
CONDITIONS_OUT = (
    "folder_id,job_id,version_serial,condition_name,odate,sign,isn,version_opcode,"
    "is_current_version,capture_date"
)
#: Layer k of the estate is a folder with k + 1 jobs; a job waits for the jobs of the layer
#: before whose number is the same or one off. Two folders are empty, one of them idle.
LAYERS = range(1, 5)
_FOLDER_NAMES = {
    f"80{k:02d}": f"PRZQ{'ABCDEF'[k - 1]}G-ZQ{'ABCDEF'[k - 1]}-{8000 + k}-LAYER{k}-DLY"
    for k in (*LAYERS, 5, 6)
}
IDLE = "8005"
ANCHOR = _FOLDER_NAMES["8004"]
_NODES = [(k, n) for k in LAYERS for n in range(1, k + 2)]


def job_name(k, n):
    return f"Q{k}_STEP{n}_RUN"


def version(k):
    """The first two layers share their versions, so pairs of job and version repeat."""
    return str(max(k - 1, 1))


_JOBS = [(f"80{k:02d}", str(n), version(k), job_name(k, n)) for k, n in _NODES]
HOPS = {(k, n): [(k - 1, m) for m in (n - 1, n, n + 1) if (k - 1, m) in _NODES] for k, n in _NODES}
_IN = [
    (f"80{k:02d}", str(n), version(k), f"{job_name(*before)}-DONE", "AND" if k % 2 else "OR")
    for (k, n), needed in HOPS.items()
    for before in needed
]
_OUT = [(f"80{k:02d}", str(n), version(k), f"{job_name(k, n)}-DONE") for k, n in _NODES]


def walked(layers=LAYERS):
    """Every path of the estate that starts in one of the layers, as lists of nodes."""
    paths, ready = [], [[node] for node in _NODES if node[0] in layers]
    while ready:
        ready = [[*path, before] for path in ready for before in HOPS[path[-1]]]
        paths += ready
    return paths


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(header.split(","))
        writer.writerows(rows)
    return str(path)


def _job_row(folder, job, version, name):
    return [
        job, version, folder, name, _FOLDER_NAMES[folder], "ZQX", "G", "Job", "N", "", job,
        "svc.batch", "author", "host-1", f"/opt/{name.lower()}.sh", "text", "", "5", "Y", "", "",
        "N", "1", "U", "20260101000000", "author", "MAIN", "2026-01-02 03:00:00",
    ]


def write_scheduler(folder):
    servers = ["S1", "S2", "S3", "S2", "S1", "S3"]
    write_csv(
        folder / "controlm_folders.csv",
        FOLDERS,
        [
            [
                fid, name, server, "" if fid == IDLE else "Y", "A", "2", "MAIN",
                "2026-01-02 03:00:00", "svc.admin", "2026-01-02 03:00:00",
            ]
            for (fid, name), server in zip(_FOLDER_NAMES.items(), servers)
        ],
    )
    write_csv(folder / "controlm_jobs.csv", JOBS, [_job_row(*job) for job in _JOBS])
    write_csv(
        folder / "controlm_conditions_in.csv",
        CONDITIONS_IN,
        [
            [f, j, v, c, "20260101", op, "", str(i), str(i), "U", "1", "2026-01-02 03:00:00"]
            for i, (f, j, v, c, op) in enumerate(_IN, 1)
        ],
    )
    write_csv(
        folder / "controlm_conditions_out.csv",
        CONDITIONS_OUT,
        [
            [f, j, v, c, "20260101", "+", "1", "U", "1", "2026-01-02 03:00:00"]
            for f, j, v, c in _OUT
        ],
    )
    return folder


APPLICATIONS = (
    "app_id,name,description,app_state,overall_risk_rating,sox_reportable,pci_reportable,"
    "hosting_vendor,programming_languages,app_owner_sid,app_owner_name,chief_tech_officer_sid,"
    "chief_tech_officer_name,info_owner_sid,info_owner_name,creation_date"
)


def write_reference(folder):
    write_csv(
        folder / "catalog_lobs.csv",
        "lob_id,code,name,reconciles_to_segment,reconcile_confidence",
        [
            ["N10", "LEND", "Lending", "AWM", "0.25"],
            ["N20", "SAVE", "Savings", "", ""],
            ["N30", "PAY", "Payments", "CIB", "0.9"],
            ["N40", "DESK", "Desks", "CIB", "0.35"],
            ["N50", "SHARED", "Shared Work", "Corp", "0.6"],
            ["N60", "LAB", "Labs", "  ", "0.1"],
        ],
    )
    write_csv(
        folder / "product_lines.csv",
        "product_line_id,name,parent_lob_id",
        [["PL1", "Boats", "N30"], ["PL2", "Farms", "N10"], ["PL3", "Lost", "N99"]],
    )
    write_csv(
        folder / "products.csv",
        "product_id,name,parent_product_line_id",
        [["P1", "Boat Loans", "PL1"], ["P2", "Boat Cover", "PL1"], ["P3", "Farm Plans", "PL2"]],
    )
    write_csv(
        folder / "seal_applications.csv",
        APPLICATIONS,
        [
            ["101", "Scan, Tools", "first\nsecond", "Operate", "Low", "No", "Yes", "[Null]", "Java | SQL",
             "E1", "Ann One", "E2", "Bob Two", "E1", "Ann Owner", "24-Aug-12"],
            ["102", "Reports", "plain", "Build", "Medium", "maybe", "N/A", "AWS", "Python",
             "E3", "", "E2", "Bob Two", "[Null]", "Nobody", "1-Jan-20"],
            ["[Null]", "Nameless", "", "", "", "", "", "", "", "", "", "", "", "", "", ""],
        ],
    )
    write_csv(
        folder / "seal_contacts.csv",
        "app_id,role_name,employee_sid,employee_name,employee_email",
        [
            ["101", "bio", "E4", "Cat Four", "cat@example.org"],
            ["101", "L2 Ops Manager", "E3", "Dan Three", "dan@example.org"],
            ["102", "Risk Manager", "E4", "", "new@example.org"],
            ["102", "Chief Dreamer", "E5", "Eve Five", "eve@example.org"],
            ["999", "cto", "E6", "Fay Six", "fay@example.org"],
        ],
    )
    write_csv(
        folder / "dev_teams.csv",
        "team_id,name,jira_board_id,parent_product_id",
        [["T1", "Pod One", "B1", "P1"], ["T2", "Pod Two", "", "P9"], ["T3", "Pod Three", "B3", ""]],
    )
    return folder
