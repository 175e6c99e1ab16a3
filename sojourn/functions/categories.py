"""Venue categories and the tag table for map data."""

from __future__ import annotations

# Unified categories and the venue types each includes.
INCLUDES: dict[str, list[str]] = {
    "food_dining": [
        "Restaurants and Other Eating Places",
        "Drinking Places (Alcoholic Beverages)",
        "Bakeries and Tortilla Manufacturing",
        "Specialty Food Stores",
        "Grocery Stores",
    ],
    "retail_general": [
        "General Merchandise Stores, including Warehouse Clubs and Supercenters",
        "Department Stores",
        "Other Miscellaneous Store Retailers",
        "Used Merchandise Stores",
        "Electronic Shopping and Mail-Order Houses",
    ],
    "retail_specialty": [
        "Clothing Stores",
        "Shoe Stores",
        "Electronics and Appliance Stores",
        "Home Furnishings Stores",
        "Furniture Stores",
        "Jewelry, Luggage, and Leather Goods Stores",
        "Sporting Goods, Hobby, and Musical Instrument Stores",
        "Office Supplies, Stationery, and Gift Stores",
        "Book Stores and News Dealers",
        "Beer, Wine, and Liquor Stores",
        "Lawn and Garden Equipment and Supplies Stores",
        "Building Material and Supplies Dealers",
    ],
    "personal_services": [
        "Personal Care Services",
        "Drycleaning and Laundry Services",
        "Other Personal Services",
        "Personal and Household Goods Repair and Maintenance",
    ],
    "pharmacy_retail": ["Health and Personal Care Stores"],
    "entertainment_recreation": [
        "Motion Picture and Video Industries",
        "Performing Arts Companies",
        "Spectator Sports",
        "Museums, Historical Sites, and Similar Institutions",
        "Amusement Parks and Arcades",
        "Other Amusement and Recreation Industries",
        "RV (Recreational Vehicle) Parks and Recreational Camps",
        "Gambling Industries",
    ],
    "accommodation_travel": [
        "Traveler Accommodation",
        "Travel Arrangement and Reservation Services",
        "Scenic and Sightseeing Transportation, Water",
        "Scenic and Sightseeing Transportation, Land",
    ],
    "financial_services": [
        "Depository Credit Intermediation",
        "Nondepository Credit Intermediation",
        "Insurance Carriers",
        "Agencies, Brokerages, and Other Insurance Related Activities",
    ],
    "professional_services": [
        "Legal Services",
        "Accounting, Tax Preparation, Bookkeeping, and Payroll Services",
        "Architectural, Engineering, and Related Services",
        "Computer Systems Design and Related Services",
        "Management, Scientific, and Technical Consulting Services",
    ],
    "automotive": [
        "Gasoline Stations",
        "Automobile Dealers",
        "Automotive Parts, Accessories, and Tire Stores",
        "Automotive Repair and Maintenance",
    ],
    "education_higher": [
        "Colleges, Universities, and Professional Schools",
        "Junior Colleges",
        "Technical and Trade Schools",
        "Other Schools and Instruction",
    ],
    "civic_community": [
        "Religious Organizations",
        "Civic and Social Organizations",
        "Social Advocacy Organizations",
        "Business, Professional, Labor, Political, and Similar Organizations",
        "Postal Service",
    ],
}

# Venue types named as excluded.
EXCLUDES: list[str] = [
    "Offices of Physicians",
    "Offices of Dentists",
    "Offices of Other Health Practitioners",
    "General Medical and Surgical Hospitals",
    "Elementary and Secondary Schools",
    "Child Day Care Services",
]

# Default tag table for OpenStreetMap venues: (key, value, category, priority); lower priority wins.
OSM_TAGS: list[tuple[str, str, str, int]] = [
    ("amenity", "restaurant", "food_dining", 1),
    ("amenity", "cafe", "food_dining", 1),
    ("amenity", "bar", "food_dining", 1),
    ("amenity", "pub", "food_dining", 1),
    ("shop", "supermarket", "food_dining", 2),
    ("shop", "bakery", "food_dining", 2),
    ("shop", "department_store", "retail_general", 2),
    ("shop", "mall", "retail_general", 2),
    ("shop", "clothes", "retail_specialty", 2),
    ("shop", "shoes", "retail_specialty", 2),
    ("shop", "electronics", "retail_specialty", 2),
    ("shop", "furniture", "retail_specialty", 2),
    ("shop", "books", "retail_specialty", 2),
    ("shop", "hairdresser", "personal_services", 2),
    ("shop", "laundry", "personal_services", 2),
    ("amenity", "pharmacy", "pharmacy_retail", 1),
    ("amenity", "cinema", "entertainment_recreation", 1),
    ("amenity", "theatre", "entertainment_recreation", 1),
    ("tourism", "museum", "entertainment_recreation", 3),
    ("leisure", "fitness_centre", "entertainment_recreation", 3),
    ("leisure", "park", "entertainment_recreation", 4),
    ("tourism", "hotel", "accommodation_travel", 3),
    ("amenity", "bank", "financial_services", 1),
    ("office", "insurance", "financial_services", 3),
    ("office", "lawyer", "professional_services", 3),
    ("office", "accountant", "professional_services", 3),
    ("amenity", "fuel", "automotive", 1),
    ("shop", "car", "automotive", 2),
    ("shop", "car_repair", "automotive", 2),
    ("amenity", "university", "education_higher", 1),
    ("amenity", "college", "education_higher", 1),
    ("amenity", "place_of_worship", "civic_community", 1),
    ("amenity", "community_centre", "civic_community", 1),
    ("amenity", "post_office", "civic_community", 1),
]
