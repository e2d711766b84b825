"""Code tables.  Fixed values: what codes and category pairs are called."""

AGENCIES = {"TVA": "Tennessee Valley Authority", "BLM": "Bureau of Land Management", "BOEM": "Bureau of Ocean Energy Management", "USBR": "Bureau of Reclamation", "FWS": "U.S. Fish and Wildlife Service", "USFS": "Forest Service", "DOD": "Department of Defense", "USACE": "Army Corps of Engineers", "DOE": "Department of Energy", "NPS": "National Park Service", "NRCS": "Natural Resources Conservation Service", "ARS": "Agricultural Research Service", "BIA": "Bureau of Indian Affairs", "NOAA": "National Oceanic and Atmospheric Administration", "BPA": "Bonneville Power Administration", "OTHF": "Other or Unknown Federal Land", "TRIB": "American Indian Lands", "SPR": "State Park and Recreation", "SDC": "State Department of Conservation", "SLB": "State Land Board"}
AGENCY_TYPES = {"FED": "Federal", "TRIB": "American Indian Lands", "STAT": "State", "DIST": "Regional Agency Special District", "LOC": "Local Government", "NGO": "Non-Governmental Organization", "PVT": "Private", "JNT": "Joint", "UNK": "Unknown", "TERR": "Territorial", "DESG": "Designation"}
ACCESS = {"OA": "Open Access", "RA": "Restricted Access", "XA": "Closed", "UK": "Unknown"}
#: Kinds of units by code.
DESIGNATIONS = {
    "NP": "National Park", "NM": "National Monument", "NCA": "Conservation Area", "NF": "National Forest", "NG": "National Grassland", "PUB": "National Public Lands", "NT": "National Scenic or Historic Trail", "NWR": "National Wildlife Refuge", "WA": "Wilderness Area", "WSR": "Wild and Scenic River",
    "WSA": "Wilderness Study Area", "MPA": "Marine Protected Area", "NRA": "National Recreation Area", "NSBV": "National Scenic, Botanical or Volcanic Area", "NLS": "National Lakeshore or Seashore", "IRA": "Inventoried Roadless Area", "ACEC": "Area of Critical Environmental Concern", "RNA": "Research Natural Area",
    "REC": "Recreation Management Area", "RMA": "Resource Management Area", "WPA": "Watershed Protection Area", "REA": "Research or Educational Area", "HCA": "Historic or Cultural Area", "MIT": "Mitigation Land or Bank", "MIL": "Military Land", "ACC": "Access Area", "SDA": "Special Designation Area",
    "PROC": "Approved or Proclamation Boundary", "FOTH": "Federal Other or Unknown", "ND": "Not Designated",
}
GAP_STATUS = {"1": "Managed for biodiversity (disturbance events proceed)", "2": "Managed for biodiversity (disturbance suppressed)", "3": "Multiple uses (extractive/OHV)", "4": "No known mandate for biodiversity protection"}
UNIT_CATEGORIES = {"Fee": "Fee", "Easement": "Easement", "Other": "Other", "Unknown": "Unknown", "Designation": "Designation", "Marine": "Marine Area", "Proclamation": "Approved, Proclamation or Extent Boundary"}
#: What pairs of class and type are called.
CATEGORIES = {
    ("amenity", "cafe"): "Coffee shop", ("amenity", "restaurant"): "Restaurant", ("amenity", "fast_food"): "Fast food restaurant", ("amenity", "bar"): "Bar", ("amenity", "pub"): "Pub", ("amenity", "biergarten"): "Beer garden", ("amenity", "ice_cream"): "Ice cream shop", ("amenity", "fuel"): "Gas station",
    ("amenity", "charging_station"): "EV charging station", ("amenity", "parking"): "Parking", ("amenity", "bank"): "Bank", ("amenity", "atm"): "ATM", ("amenity", "pharmacy"): "Pharmacy", ("amenity", "hospital"): "Hospital", ("amenity", "clinic"): "Clinic", ("amenity", "dentist"): "Dentist",
    ("amenity", "doctors"): "Doctor's office", ("amenity", "veterinary"): "Veterinarian", ("amenity", "school"): "School", ("amenity", "university"): "University", ("amenity", "college"): "College", ("amenity", "library"): "Library", ("amenity", "post_office"): "Post office",
    ("amenity", "fire_station"): "Fire station", ("amenity", "police"): "Police station", ("amenity", "townhall"): "Town hall", ("amenity", "place_of_worship"): "Place of worship", ("amenity", "theatre"): "Theatre", ("amenity", "cinema"): "Cinema", ("amenity", "community_centre"): "Community center",
    ("amenity", "toilets"): "Restrooms", ("amenity", "drinking_water"): "Drinking water", ("amenity", "shelter"): "Shelter", ("amenity", "camping"): "Campground",
    ("shop", "supermarket"): "Supermarket", ("shop", "convenience"): "Convenience store", ("shop", "hardware"): "Hardware store", ("shop", "clothes"): "Clothing store", ("shop", "car_repair"): "Auto repair", ("shop", "car"): "Car dealership", ("shop", "bakery"): "Bakery", ("shop", "butcher"): "Butcher",
    ("leisure", "park"): "Park", ("leisure", "playground"): "Playground", ("leisure", "sports_centre"): "Sports center", ("leisure", "swimming_pool"): "Swimming pool", ("leisure", "golf_course"): "Golf course", ("leisure", "nature_reserve"): "Nature reserve", ("leisure", "campsite"): "Campsite",
    ("tourism", "hotel"): "Hotel", ("tourism", "motel"): "Motel", ("tourism", "guest_house"): "Guest house", ("tourism", "hostel"): "Hostel", ("tourism", "camp_site"): "Campsite", ("tourism", "viewpoint"): "Viewpoint", ("tourism", "museum"): "Museum", ("tourism", "information"): "Information",
    ("tourism", "attraction"): "Tourist attraction", ("tourism", "picnic_site"): "Picnic site",
    ("natural", "peak"): "Peak", ("natural", "spring"): "Spring", ("natural", "hot_spring"): "Hot spring", ("natural", "lake"): "Lake", ("natural", "water"): "Water body", ("natural", "cliff"): "Cliff", ("natural", "cave_entrance"): "Cave",
    ("highway", "bus_stop"): "Bus stop", ("highway", "rest_area"): "Rest area",
    ("boundary", "administrative"): "Administrative boundary", ("boundary", "protected_area"): "Protected area", ("boundary", "national_park"): "National park",
    ("place", "city"): "City", ("place", "town"): "Town", ("place", "village"): "Village", ("place", "hamlet"): "Hamlet", ("place", "suburb"): "Suburb", ("place", "neighbourhood"): "Neighborhood",
    ("building", "yes"): "Building",
    ("waterway", "river"): "River", ("waterway", "stream"): "Stream", ("waterway", "waterfall"): "Waterfall",
    ("landuse", "cemetery"): "Cemetery", ("landuse", "forest"): "Forest",
    ("historic", "monument"): "Monument", ("historic", "memorial"): "Memorial", ("historic", "ruins"): "Ruins",
}
CLASS_LABELS = {"shop": "Shop", "amenity": "Amenity", "leisure": "Leisure", "tourism": "Tourism", "natural": "Natural feature", "historic": "Historic site"}


def state_names() -> dict[str, str]:
    """Names of states by code, as they are written."""
    from .text import STATES

    return {code: " ".join(w.capitalize() for w in name.split()) if name else "District of Columbia" for code, name in STATES.items()}
