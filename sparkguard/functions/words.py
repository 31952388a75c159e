"""Replacement words for the masks."""

FIRST_NAMES = "Ada Ben Cleo Dan Elsa Finn Gwen Hugo Iris Joel Kira Liam Mona Nils Olga Pete".split()
LAST_NAMES = "Abbot Brook Carver Dyer Ellis Frost Gale Hale Irwin Joyce Kerr Lowell Marsh Noble Orr Pike".split()
TLDS = ["com", "net", "org"]
STREETS = "Oak Elm Birch Cedar Maple Willow Aspen Hazel".split()
STREET_KINDS = ["Street", "Avenue", "Lane", "Road"]
CITIES = "Ashford Bridgeton Clayville Dunmore Eastham Fairview Glenrock Holbrook".split()
STATES = "Alabama Colorado Delaware Georgia Idaho Kansas Maine Nevada Ohio Oregon Texas Utah".split()
COMPANY_KINDS = ["Group", "Inc", "Ltd", "and Sons"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
