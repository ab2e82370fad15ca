"""specula.sources"""
