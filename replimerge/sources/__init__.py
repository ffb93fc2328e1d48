"""Tables in and out: listings, state tables, upserts, differences."""
