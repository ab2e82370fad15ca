"""specula.plans"""
