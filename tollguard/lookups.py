"""Fixed reference values: agency names and states, plaza names, code classes.

Fixed values. They have to equal the published toll codes for results to be right, so they
are spelled out plainly here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Agency code, agency name, state.
AGENCIES = [
    ("GSP", "Garden State Parkway", "NJ"),
    ("NJTP", "New Jersey Turnpike", "NJ"),
    ("SJ", "South Jersey Transportation Authority", "NJ"),
    ("PTC", "Pennsylvania Turnpike Commission", "PA"),
    ("DRJTBC", "Delaware River Joint Toll Bridge Commission", "PA"),
    ("DRPA", "Delaware River Port Authority", "PA"),
    ("PANYNJ", "Port Authority of NY & NJ", "NY"),
    ("BCBC", "Burlington County Bridge Commission", "PA"),
    ("NJ E-ZPASS", "NJ E-ZPass (back office)", "NJ"),
    ("CBDTP", "Central Business District Tolling Program", "NY"),
    ("DELDOT", "Delaware Department of Transportation", "DE"),
    ("DRBA", "Delaware River & Bay Authority", "DE"),
    ("ILTOLL", "Illinois Tollway Authority", "IL"),
    ("ITRCC", "Indiana Toll Road Concession Company", "IN"),
    ("MASSDOT", "Massachusetts Department of Transportation", "MA"),
    ("MDTA", "Maryland Transportation Authority", "MD"),
    ("META", "Maine Turnpike Authority", "ME"),
    ("MTAB&T", "MTA Bridges and Tunnels", "NY"),
    ("NHDOT", "New Hampshire Department of Transportation", "NH"),
    ("NYSBA", "New York State Bridge Authority", "NY"),
    # The name below is not NYSTA's own; downstream reports expect it as it is.
    ("NYSTA", "New York State Bridge Authority", "NY"),
    ("OTIC", "Ohio Turnpike and Infrastructure Commission", "OH"),
    ("VDOT", "Virginia Department of Transportation", "VA"),
]

# Plaza code, plaza name. One list serves entry and exit plazas.
PLAZAS = [
    # Garden State Parkway
    ("PVK", "Pascack Valley"),
    ("PRS", "Paramus South"),
    ("PRN", "Paramus North"),
    ("BER", "Bergen"),
    ("SAB", "Saddle Brook"),
    ("CLS", "Clifton South"),
    ("CLN", "Clifton North"),
    ("PSS", "Passaic South"),
    ("PSN", "Passaic North"),
    ("WAS", "Watchung South"),
    ("WAN", "Watchung North"),
    ("ESS", "Essex"),
    ("BLS", "Bloomfield South"),
    ("BLN", "Bloomfield North"),
    ("EOR", "East Orange"),
    ("IRS", "Irvington South"),
    ("IRN", "Irvington North"),
    ("UNR", "Union Ramp"),
    ("UNI", "Union"),
    ("RAS", "Raritan South"),
    ("MAT", "Matawan"),
    ("KEY", "Keyport"),
    ("HOS", "Holmdel South"),
    ("HON", "Holmdel North"),
    ("RBS", "Red Bank South"),
    ("RBN", "Red Bank North"),
    ("EAT", "Eatontown"),
    ("ASP", "Asbury Park"),
    ("BES", "Belmar South"),
    ("BEN", "Belmar North"),
    ("BRS", "Brick South"),
    ("BRN", "Brick North"),
    ("LWS", "Lakewood South"),
    ("LWN", "Lakewood North"),
    ("TRV", "Toms River"),
    ("LRS", "Lacey Rd South"),
    ("LRN", "Lacey Rd North"),
    ("BAR", "Barnegat"),
    ("BKS", "Berkeley Ramp South"),
    ("BKN", "Berkeley Ramp North"),
    ("NGR", "New Gretna"),
    ("WRS", "Waretown South"),
    ("WRN", "Waretown North"),
    ("SPT", "Somers Point"),
    ("GEG", "Great Egg"),
    ("CMY", "Cape May"),
    ("WWS", "Wildwood South"),
    ("WWN", "Wildwood North"),
    ("SAY", "Sayreville"),
    # New Jersey Turnpike
    ("1", "Delaware Memorial Bridge"),
    ("2", "Swedesboro/Chester"),
    ("3", "Woodbury/S. Camden/NJ Aquarium"),
    ("4", "Camden/Philadelphia/NJ Aquarium"),
    ("5", "Burlington/Mt. Holly"),
    ("6", "PA Turnpike/Florence"),
    ("6A", "PA Turnpike/Florence"),
    ("6B", "Rte. 130 Credit Ramp"),
    ("7", "Bordentown/Trenton"),
    ("7A", "I-195/Trenton/Shore Points"),
    ("8", "Hightstown/Freehold"),
    ("8A", "Jamesburg/Cranbury"),
    ("9", "New Brunswick/Admin Bldg"),
    ("10", "I-287/Metuchen/Edison Twsp"),
    ("11", "GSP/Woodbridge/The Amboys"),
    ("12", "Carteret/Rahway"),
    ("13", "I-278/Eliz/Goethals/Verrazano"),
    ("13A", "Newark Aprt/Elizabeth Seaport"),
    ("14", "I-78/Newark Airport"),
    ("14A", "Bayonne"),
    ("14B", "Jersey City/Liberty State Park"),
    ("14C", "Holland Tunnel"),
    ("15E", "Newark/Jersey City"),
    ("15W", "I-280/Newark/The Oranges"),
    ("15X", "Secaucus Transfer Station"),
    ("16E", "Lincoln Tunnel/NJ 3/Secaucus"),
    ("16W", "Sprtsplx/NJ 3/Secaucus/Ruthrfrd"),
    ("17", "Secaucus/US 46"),
    ("18E", "Lincoln Tunnel/NJ 3/Secaucus"),
    ("18W", "Geo Washington Br/US 46/I-80"),
    ("19W", "Carlstadt"),
    # South Jersey
    ("APL", "Pleasantville Mainline Barrier"),
    ("AR9", "Route 9"),
    ("APO", "Pomona"),
    ("ACY", "AC Airport"),
    ("AML", "Mays Landing"),
    ("A50", "Route 50"),
    ("AEH", "Egg Harbor Mainline Barrier"),
    ("AH", "Hammonton Ramp"),
    ("AWN", "Winslow Ramp"),
    ("AWL", "Williamstown Ramp"),
    ("ACK", "Cross Keys"),
    ("OCL", "Ocean City-Longport Bridge"),
    ("CIB", "Corsons Inlet Bridge"),
    ("TIB", "Townsends Inlet Bridge"),
    ("GSB", "Grassy Sound Bridge"),
    ("MTB", "Middle Thorofare Bridge"),
    # Delaware River Port Authority
    ("BRB", "Betsy Ross Br"),
    ("BFB", "Ben Franklin Br"),
    ("WWB", "Walt Whitman Br"),
    ("CBB", "Commodore Barry Br"),
    # Delaware River & Bay Authority
    ("DMB", "Delaware Memorial Br"),
    # Burlington County Bridge Commission
    ("TPB", "Tacony Palmyra Br"),
    ("BBB", "Burlington Bristol Br"),
    # Delaware River Joint Toll Bridge Commission
    ("T-M", "Trenton-Morrisville Br"),
    ("NHL", "New Hope-Lambertville Br"),
    ("I78", "I-78 Br"),
    ("E-P", "Easton-Phillipsburg Br"),
    ("P-C", "Portland-Columbia Br"),
    ("DWG", "Delaware Water Gap Br"),
    ("M-M", "Milford-Montague Br"),
    ("O78", "Interstate 78-ORT"),
    ("ODW", "Delaware Water Gap-ORT"),
    ("OSF", "Scudder Falls Br"),
]

# Vehicle type codes by class.
PASSENGER_CODES = ["1", "2", "2L", "2H"]
LIGHT_COMMERCIAL_CODES = ["3", "3L", "3H", "B2", "B3"]
HEAVY_COMMERCIAL_CODES = ["4", "5", "6", "7", "8", "9", "4L", "4H", "5H", "6H", "7H"]

# Month names and abbreviations found in statement file names.
MONTHS = {
    "january": 1, "jan": 1,
    "february": 2, "feb": 2,
    "march": 3, "mar": 3,
    "april": 4, "apr": 4,
    "may": 5,
    "june": 6, "jun": 6,
    "july": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10,
    "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}

# Review states.
NEEDS_REVIEW = "Needs Review"
INVESTIGATING = "Investigating"
NO_ACTION = "No Action Required"
RESOLVED = ["Resolved - Not Fraud", "Resolved - Fraud"]

# Risk categories, most severe first.
SEVERITY_ORDER = ["Critical Risk", "High Risk", "Medium Risk", "Low Risk", "No Risk"]


def agencies(spark: SparkSession) -> DataFrame:
    """Agency dimension (23 rows): ``agency, agency_name, state_name``."""
    return spark.createDataFrame(AGENCIES, "agency string, agency_name string, state_name string")


def plazas(spark: SparkSession) -> DataFrame:
    """Plaza dimension (113 rows): ``plaza, plaza_name``."""
    return spark.createDataFrame(PLAZAS, "plaza string, plaza_name string")
