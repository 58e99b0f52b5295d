"""Moving, reshaping and checking tables at scale, as DataFrame operators on Spark."""
