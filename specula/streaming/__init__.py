"""specula.streaming"""
