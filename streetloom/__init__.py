"""Map, population and transit analytics over OpenStreetMap-shaped tables, written as Spark jobs."""
